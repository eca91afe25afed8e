"""PII: keyed, type-consistent surrogates for detected entities.

One pattern finds mentions; a mention's identity is its type and what is the same in all ways of writing it (digits of
a number, lower-cased address). A surrogate is drawn per identity from a keyed digest and has the identity's shape: letters
stay letters of the same case, digits digits, octets octets, a valid card number a valid one. Each mention shows it in its
own format, so mentions of one entity stay mentions of one entity, across documents too.

Persons are found by a title, and their names are replaced word by word, so that full, short and initialled forms keep
belonging together: "Mr John Smith", "John Smith", "Mr Smith", "SMITH" and "J. Smith" share their surrogate words. Every
word of a titled name is replaced wherever its document writes it with a capital, title or not. A word's identity is the
word with its gender: that of the titles before it, none for a family name after a given one and for a word that one
document uses in several roles. Surrogate words keep script and initial (bare initials stay as they are) and end by
gender; the same word has the same stem under every gender.

Collision checks run over all identities: a surrogate may neither belong to two identities nor be the value of a real
one. Of several claimants the smallest keeps it, the others draw again, until no collision is left.

Without the key surrogates cannot be linked to originals; pass it from a secret store.

Defined results: null texts stay null; texts without mentions pass unchanged (they take part in no join); equal rows get
equal results; an empty table gives no rows; other columns pass through, whatever their names, but for an ``n_entities``
of the caller, which is replaced. Names of persons that no title introduces in their document are not detected; a
capitalised word that follows a titled name directly is taken for a part of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segloom.llm.tables import cut, row_key

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
ADDRESS = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
PHONE = (
    r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}"
    r"|\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4})(?![0-9])"
)
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
SECRET = r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|(?=[a-f]*[0-9])[0-9a-f]{16,64})(?![0-9A-Za-z])"
_MALE = r"Mr|Herr|Señor|Sr|Monsieur|господин|г-н"
_FEMALE = r"Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|госпожа|г-жа"
_TITLES = f"{_FEMALE}|{_MALE}|Dr|Prof"
#: One word of a name; only letters, apostrophes and hyphens, so it needs no quoting in a pattern.
WORD = r"\p{Lu}(?:\p{L}+(?:['-]\p{L}{2,})*|(?:['-]\p{L}{2,})+)"
NAME = rf"(?<!\p{{L}})(?:{_TITLES})\.? (?:\p{{Lu}}\. ?)*{WORD}(?: (?:\p{{Lu}}\. ?)?{WORD}){{0,2}}"
OTHER = "|".join((EMAIL, ADDRESS, PHONE, SOCIAL, CARD, SECRET))
MENTION = f"{OTHER}|{NAME}"
_TITLE = rf"^(?:{_TITLES})\.? "
#: Syllables of drawn names, and endings by script and gender (x: none). No ending is the end of another one.
SYLLABLES = {
    "latin": ["ba", "ce", "di", "fo", "ga", "he", "ji", "ko", "lu", "ma", "ne", "pi", "ro", "sa", "te", "vi"],
    "cyrillic": ["ба", "ве", "ди", "жо", "за", "ке", "ли", "мо", "ну", "па", "ре", "си", "то", "фа", "хе", "ши"],
}
ENDINGS = {
    "latin": {"f": "na", "m": "n", "n": "l", "x": "r"},
    "cyrillic": {"f": "на", "m": "н", "n": "л", "x": "р"},
}
_HEX = 128


def mention_type(m: Column) -> Column:
    """Type of a mention that is no name."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    return (
        F.when(m.contains("@"), "email").when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "address")
        .when(m.rlike("[A-Za-z]"), "secret").when(m.startswith("+") | m.startswith("("), "phone")
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "social").when(F.length(digits) >= 13, "card").otherwise("phone")
    )


def _gender(m: Column) -> Column:
    return F.when(m.rlike(rf"^(?:{_FEMALE})\.? "), "f").when(m.rlike(rf"^(?:{_MALE})\.? "), "m").otherwise("n")


def name_form(word: Column) -> Column:
    """A word of a name as its identity has it, in any writing."""
    return F.initcap(word)


def _name_words(m: Column) -> Column:
    """``w, g`` of the words of one titled name; titles among them are none."""
    found = F.regexp_extract_all(F.regexp_replace(m, _TITLE, ""), F.lit(WORD), F.lit(0))
    words = F.transform(F.filter(found, lambda w: ~w.rlike(rf"^(?:{_TITLES})$")), name_form)
    family = F.when(F.size(words) > 1, "x").otherwise(_gender(m))
    return F.transform(words, lambda w, i: F.struct(
        w.alias("w"), F.when(i == F.size(words) - 1, family).otherwise(_gender(m)).alias("g")))


def _one_gender(before: Column, g: Column) -> Column:
    """Of two uses of a word: the one that says more, none if they differ."""
    return F.when(before.isin("", "n") | (before == g), g).when(g == "n", before).otherwise("x")


def person_words(docs: DataFrame, names: str = "names") -> DataFrame:
    """``docs`` with ``people``: ``w, g`` of the different words of the titled names in ``names``."""
    listed = docs.withColumn("__used", F.flatten(F.transform(names, _name_words)))
    words = F.array_distinct(F.transform("__used", lambda x: x["w"]))
    return listed.withColumn("people", F.transform(words, lambda w: F.struct(
        w.alias("w"),
        F.aggregate(F.filter("__used", lambda x: x["w"] == w), F.lit(""), lambda g, x: _one_gender(g, x["g"])).alias("g"),
    ))).drop("__used")


def document_pattern(people: Column) -> Column:
    """The pattern of one document: all other mentions, and its name words, longer ones first."""
    words = F.transform(
        F.sort_array(F.transform(people, lambda x: F.struct(F.length(x["w"]).alias("n"), x["w"].alias("w"))), asc=False), lambda x: x["w"])
    any_word = F.concat(F.lit(OTHER + r"|(?<!\p{L})(?=\p{Lu})(?iu:"), F.array_join(words, "|"), F.lit(r")(?!\p{L})"))
    return F.when(F.size(people) > 0, any_word).otherwise(OTHER)


def identity(kind: Column, m: Column) -> Column:
    """What is the same in all writings of a mention that is no name."""
    return F.when(kind == "email", F.lower(m)).when(kind.isin("address", "secret"), m).otherwise(F.regexp_replace(m, "[^0-9]", ""))


def _bare(kind: Column, value: Column) -> Column:
    """An identity or surrogate as texts show it: names without their gender."""
    return F.when(kind == "name", F.substr(value, F.lit(3), F.length(value))).otherwise(value)


def _stream(key: str) -> Column:
    """Hex digits drawn for an identity and an attempt."""
    seed = F.concat_ws("\u001f", F.lit(key), "kind", _bare(F.col("kind"), F.col("ident")), F.col("attempt").cast("string"))
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f"\u001f{i}")).cast("binary"), 256) for i in range(_HEX * 2 // 64)])


def _number(i: Column) -> Column:
    """0 to 255 for the i-th character."""
    return F.conv(F.substr(F.col("stream"), (i % _HEX) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _shaped(value: Column) -> Column:
    """Every letter and digit drawn anew within its class; hexadecimal secrets stay hexadecimal."""
    hexadecimal = value.rlike("^[0-9a-f]+$")

    def one(c: Column, i: Column) -> Column:
        n = _number(i)
        return (
            F.when(c.rlike("[0-9]"), (n % 10).cast("string"))
            .when(c.rlike("[a-f]") & hexadecimal, F.substr(F.lit("abcdef"), n % 6 + 1, F.lit(1)))
            .when(c.rlike("[a-z]"), F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), n % 26 + 1, F.lit(1)))
            .when(c.rlike("[A-Z]"), F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), n % 26 + 1, F.lit(1))).otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Check sum of a number: 0 modulo 10 for a valid one."""
    def add(total: Column, x: Column) -> Column:
        d = F.when(x["odd"], 2 * x["d"]).otherwise(x["d"])
        return total + F.when(d > 9, d - 9).otherwise(d)

    numbered = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.cast("int").alias("d"), (i % 2 == 1).alias("odd")))
    return F.aggregate(F.filter(numbered, lambda x: x["d"].isNotNull()), F.lit(0), add)


def _card(value: Column) -> Column:
    """Same first digit and length; valid if the original is."""
    drawn = F.concat(F.substr(value, F.lit(1), F.lit(1)), F.substr(_shaped(value), F.lit(2), F.length(value) - 2))
    check = ((F.lit(10) - _luhn(F.concat(drawn, F.lit("0"))) % 10) % 10).cast("string")
    return F.concat(drawn, F.when(_luhn(value) % 10 == 0, check).otherwise(F.substr(_shaped(value), F.length(value), F.lit(1))))


def _phone(value: Column) -> Column:
    """Country and exchange-like leading digit stay; the rest is drawn."""
    return F.concat(F.substr(value, F.lit(1), F.lit(1)), F.substr(_shaped(value), F.lit(2), F.length(value)))


def _email(value: Column) -> Column:
    top = F.regexp_extract(value, r"\.[a-z]+$", 0)
    return F.concat(_shaped(F.substr(value, F.lit(1), F.length(value) - F.length(top))), top)


def _secret(value: Column) -> Column:
    """The prefix that names a kind of key stays."""
    prefix = F.regexp_extract(value, "^(AKIA)?", 0)
    return F.concat(prefix, F.substr(_shaped(value), F.length(prefix) + 1, F.length(value)))


def _address() -> Column:
    return F.concat_ws(".", *[(_number(F.lit(i)) % 254 + 1).cast("string") for i in range(4)])


def _name(value: Column) -> Column:
    """A word of the same script, initial and gender; longer with every second attempt."""
    gender, name = F.substr(value, F.lit(1), F.lit(1)), F.substr(value, F.lit(3), F.length(value))
    steps = F.sequence(F.lit(0), F.lit(3) + F.floor(F.col("attempt") / 2).cast("int"))

    def made(script: str) -> Column:
        table, end = F.array(*map(F.lit, SYLLABLES[script])), F.lit(None).cast("string")
        for g, letters in ENDINGS[script].items():
            end = F.when(gender == g, letters).otherwise(end)
        drawn = F.array_join(F.transform(steps, lambda j: F.get(table, _number(j) % 16)), "")
        first = F.when(name.rlike("^[A-Z]" if script == "latin" else r"^\p{IsCyrillic}"), F.substr(name, F.lit(1), F.lit(1))).otherwise(
            F.initcap(F.substr(drawn, F.lit(1), F.lit(1))))
        return F.concat(first, F.substr(drawn, F.lit(2), F.length(drawn)), end)

    return F.concat(gender, F.lit(":"), F.when(name.rlike(r"^\p{IsCyrillic}"), made("cyrillic")).otherwise(made("latin")))


def _draw(entities: DataFrame, key: str) -> DataFrame:
    made = entities.withColumn("stream", _stream(key))
    value = F.col("ident")
    return made.withColumn(
        "surrogate",
        F.when(F.col("kind") == "email", _email(value)).when(F.col("kind") == "address", _address()).when(F.col("kind") == "name", _name(value))
        .when(F.col("kind") == "card", _card(value)).when(F.col("kind") == "phone", _phone(value))
        .when(F.col("kind") == "secret", _secret(value)).otherwise(_shaped(value)),
    ).drop("stream")


def surrogate_table(mentions: DataFrame, key: str) -> DataFrame:
    """``kind, ident, surrogate`` of all identities, one to one and disjoint from all real identities."""
    real = cut(mentions.select("kind", "ident").distinct())
    drawn = cut(_draw(real.withColumn("attempt", F.lit(0)), key))
    while True:
        taken = drawn.groupBy("kind", "surrogate").agg(F.min("ident").alias("owner"))
        known = real.select("kind", _bare(F.col("kind"), F.col("ident")).alias("__bare")).distinct().withColumn("__real", F.lit(True))
        checked = cut(drawn.withColumn("__bare", _bare(F.col("kind"), F.col("surrogate"))).join(taken, ["kind", "surrogate"]).join(
            known, ["kind", "__bare"], "left"
        ).withColumn("bad", F.col("__real").isNotNull() | (F.col("owner") != F.col("ident"))))
        if checked.filter("bad").isEmpty():
            return drawn.select("kind", "ident", "surrogate")
        again = _draw(checked.filter("bad").select("kind", "ident", (F.col("attempt") + 1).alias("attempt")), key)
        drawn = cut(checked.filter("not bad").select("kind", "ident", "attempt", "surrogate").unionByName(
            again.select("kind", "ident", "attempt", "surrogate")))


def _shown(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate in the format of one mention."""
    digits = F.aggregate(
        F.split(mention, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("j")),
        lambda s, c: F.when(
            c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substr(surrogate, s["j"], F.lit(1))).alias("out"), (s["j"] + 1).alias("j"))
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["j"].alias("j"))),
    )["out"]
    word = _bare(kind, surrogate)
    return (
        F.when(kind.isin("email", "address", "secret"), surrogate)
        .when(kind == "name", F.when((mention == F.upper(mention)) & (F.length(mention) > 1), F.upper(word)).otherwise(word)).otherwise(digits)
    )


def replace_entities(docs: DataFrame, key: str, *, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """``docs`` with every mention replaced in ``text``, and ``n_entities`` (a name of several words is one mention)."""
    body = F.col(text)
    listed = docs.filter(body.rlike(MENTION)).select(
        F.col(doc).alias("__d"), row_key(docs).alias("__k"), body.alias("__t"),
        F.regexp_extract_all(body, F.lit(NAME), F.lit(0)).alias("names"),
    )
    named = person_words(listed).withColumn("pattern", document_pattern(F.col("people")))
    named = cut(named.select("__d", "__k", "people", "pattern", F.regexp_extract_all("__t", F.col("pattern"), F.lit(0)).alias("m")).dropDuplicates(["__d", "__k"]))
    role = F.get(F.filter("people", lambda x: x["w"] == name_form(F.col("mention"))), F.lit(0))["g"]
    mentions = named.select("__d", "__k", "pattern", "people", F.posexplode("m").alias("at", "mention")).withColumn("role", role).drop("people")
    kind = F.when(F.col("role").isNotNull(), "name").otherwise(mention_type(F.col("mention")))
    mentions = cut(mentions.withColumn("kind", kind).withColumn("ident", F.when(
        F.col("kind") == "name", F.concat("role", F.lit(":"), name_form(F.col("mention")))
    ).otherwise(identity(F.col("kind"), F.col("mention")))))
    table = surrogate_table(mentions, key)
    shown = mentions.join(table, ["kind", "ident"]).select(
        "__d", "__k", "at", "pattern", (F.col("kind") == "name").alias("name"), _shown(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("s"))
    per_row = cut(shown.groupBy("__d", "__k").agg(
        F.first("pattern").alias("__pattern"), F.array_sort(F.collect_list(F.struct("at", "name", "s"))).alias("__shown")
    ))
    keyed = docs.withColumn("__key", row_key(docs)).withColumn("__has", F.coalesce(body.rlike(MENTION), F.lit(False)))
    plain = keyed.filter(~F.col("__has")).drop("__key", "__has").withColumn("n_entities", F.lit(0).cast("long"))
    joined = keyed.filter("__has").join(per_row, (F.col("__key") == F.col("__k")) & F.col(doc).eqNullSafe(F.col("__d")), "left")
    pieces = F.zip_with(
        F.split(body, F.col("__pattern"), -1), "__shown",
        lambda a, b: F.struct(a.alias("before"), F.coalesce(b["s"], F.lit("")).alias("s"), F.coalesce(b["name"], F.lit(False)).alias("name")),
    )
    joined = joined.withColumn("__pieces", pieces)
    goes_on = lambda x: x["name"] & x["before"].rlike(r"^ (?:\p{Lu}\. ?)*$")
    count = F.aggregate(
        "__pieces", F.struct(F.lit(-1).cast("long").alias("n"), F.lit(False).alias("name")),
        lambda t, x: F.struct((t["n"] + F.when(t["name"] & goes_on(x), 0).otherwise(1)).alias("n"), x["name"].alias("name")),
    )["n"]
    rebuilt = F.array_join(F.transform("__pieces", lambda x: F.concat(x["before"], x["s"])), "")
    replaced = joined.withColumn("n_entities", F.coalesce(count, F.lit(0).cast("long"))).withColumn(text, F.coalesce(rebuilt, body))
    return plain.unionByName(replaced.drop("__key", "__has", "__d", "__k", "__pattern", "__shown", "__pieces"))
