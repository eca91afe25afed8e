"""Results depend on these exact words, ranges and numbers."""

# Characters Python's str.isspace() accepts.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Special spaces treated as a plain space when style text is compared.
STYLE_SPACES = "\u00a0\u2002\u2003\u2009\u200a\u3000"

# Code point ranges (Hangul, Jamo, Kana, Han, Han extension A).
CJK_CLASS = r"\x{AC00}-\x{D7A3}\x{1100}-\x{11FF}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}"
# The narrower class used for phrase propagation, and Hangul alone.
PHRASE_CJK_CLASS = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}"
HANGUL_CLASS = r"\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{AC00}-\x{D7A3}"

# Function words that mark Latin-script prose.
FUNCTION_WORDS = (
    "the a an is are was were be been to of in on for and or with by from as at this "
    "that we you it not no will has have had but if than then into per via our their"
).split()
EDGE_PUNCTUATION = ".,;:!?()[]'\""

# Glyph width factors in hundredths of the font size.
WIDTH_CJK, WIDTH_SPACE, WIDTH_NARROW, WIDTH_WIDE, WIDTH_OTHER = 100, 33, 30, 85, 55
NARROW_GLYPHS = "ilI.,'`|!:;"
WIDE_GLYPHS = "MW@#%&"

# Colour scheme slots that count as plain text.
NEUTRAL_SCHEMES = ["tx1", "tx2", "dk1", "dk2", "lt1", "lt2", "bg1", "bg2"]
NEUTRAL_SPREAD = 12

# Display names of languages by detected code.
LANGUAGE_NAMES = {
    "ko": "한국어",
    "en": "영어",
    "ja": "일본어",
    "zh-cn": "중국어",
    "zh": "중국어",
    "es": "스페인어",
    "fr": "프랑스어",
    "de": "독일어",
}
DEFAULT_LANGUAGE = "영어"
CJK_LANGUAGES = ["한국어", "일본어", "중국어"]
# Display name to ISO code, for the detector and for direction codes.
LANGUAGE_ISO = {"한국어": "ko", "영어": "en", "일본어": "ja", "중국어": "zh-cn"}
DIRECTION_ISO = {"한국어": "ko", "영어": "en", "일본어": "ja", "중국어": "zh"}

# Length histogram labels with their upper bounds.
LENGTH_BUCKETS = [
    ("1-5", 5), ("6-10", 10), ("11-20", 20), ("21-40", 40), ("41-80", 80), ("81-160", 160),
]
LENGTH_BUCKET_LAST = "161+"

# Glossary limits and header labels.
MAX_GLOSSARY_ENTRIES = 5000
MAX_LIBRARY_ENTRIES = 10000
MAX_TERM_CHARS = 500
MAX_NOTES_CHARS = 2000
MAX_NAME_CHARS = 100
HEADER_SOURCE = ["원문", "source", "소스", "용어", "term"]
HEADER_TARGET = ["번역", "target", "타겟", "번역어", "translation"]
EXPORT_HEADER = ["원문", "번역", "메모"]
DEFAULT_GLOSSARY_NAME = "기본 용어집"

# Finding severities, worst first.
SEVERITY_RANK = {"critical": 0, "major": 1, "minor": 2}
NO_SEVERITY_RANK = 3

# Text-fit geometry.
EMU_PER_POINT = 12700
DEFAULT_FONT_PT = 18.0
LINE_HEIGHT = 1.2
EXPANSION_GAP_EMU = 457200
FIT_TOLERANCE = 1.05
LENGTH_TOLERANCE = 1.10
EXPAND_MODES = ["expand_box", "shrink_then_expand"]

# Block merging.
MAX_BLOCK_SIZE = 4
SOLITARY_KINDS = ["body", "notes"]
SENTENCE_END = r"[.!?。！？…:;]['\"”’)\]]*$"
MID_CLAUSE_END = r"[,،、]$"

# Finding descriptions.
TERM_MESSAGE = '용어집: "%1$s" → "%2$s" 인데 번역에 "%2$s"가 없습니다.'
LOCKED_MESSAGE = '확정 용어 규칙(%1$s): "%2$s" 표기를 정확히 지켜야 합니다.'
DIVERGENCE_MESSAGE = (
    '같은 원문 "%1$s"가 슬라이드 %2$d에서는 "%3$s", 슬라이드 %4$d에서는 "%5$s"로 '
    "다르게 번역됐습니다. 하나로 통일하세요."
)
UNTRANSLATED_MESSAGE = "번역되지 않고 원문이 그대로 남아 있습니다."
OVERFLOW_MESSAGE = "번역 %1$d자가 예상 박스 용량 %2$d자를 초과합니다."
LENGTH_LIMIT_MESSAGE = "번역 %1$d자가 설정한 최대 %2$d자(%3$d%%)를 초과합니다."
STYLE_MESSAGE = (
    "원문의 부분 강조를 모두 확실하게 매핑하지 못했습니다. 색상 미리보기를 확인하세요."
)
REJECTED_MESSAGE = "검토 화면에서 검출 무시(반려)"
ACCEPTED_MESSAGE = "검토 화면에서 수정 (전파 %1$d건)"

# Fixed values of Unicode casefolding beyond lower case, for scripts with case in common use.
FOLD_LETTERS = {"ς": "σ", "ſ": "s", "ϐ": "β", "ϑ": "θ", "ϕ": "φ", "ϖ": "π", "ϰ": "κ", "ϱ": "ρ", "ϵ": "ε"}
FOLD_SEQUENCES = {"ß": "ss", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
