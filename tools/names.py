"""Names of the queries registered by the given catalog modules."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from segloom import catalog  # noqa: E402

print(" ".join(k for k, v in catalog.QUERIES.items() if v.__module__.rsplit(".", 1)[1] in sys.argv[1:]))
