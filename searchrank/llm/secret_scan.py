"""Secret scans: base patterns, and random strings found by token efficiency.

Base spans, leftmost and non-overlapping per kind, offsets in code points:

* ``assign``: a password-like key, ``:`` or ``=``, and a value of 8 or more characters;
* ``access``: ``AKIA`` and upper-case letters or digits, 16 or more characters together;
* ``hex``: 32 or more hexadecimal digits.

The method adds ``random``: a run of 16 or more letters, digits and ``+/_-`` that a byte-pair vocabulary
spells with few characters per token.  Words of any language that the vocabulary knows
something of take three or more characters a token; random strings about two or fewer.  A whole run
is tested if it has digits; if it does not count, each of its segments of 16 or more letters, digits and ``+`` is
tested by itself, one of letters alone lower-cased and under a tighter limit.  Spans of base are left out, and so are
hexadecimal strings (base has the long ones), UUIDs, dates and times, numbers with a short unit,
host and path of a web address and the name in a mail address.  Keys in its query or
before the ``@`` of its host are tested.

The vocabulary file's bytes are broadcast; their size is the file's.  Every row is scanned
whole; rows never meet, so there is no shuffle.  Null and empty texts have no spans; repeated ids
give a row each.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
KNOWN = re.compile(
    r"[0-9a-fA-F]+|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9+/_-]+|[0-9+/_-]*[A-Za-z]{1,3}[0-9+/_-]*")
SEGMENT = re.compile(r"[A-Za-z0-9+]{16,}")
URL = re.compile(r"""(?:://|www\.)([^\s?#"'<>,;)]*)""")
LOGIN_STOP = re.compile(r"[\s/?#]")
MAIL_STOP = re.compile(r"[^A-Za-z0-9._+-]")
MAIL_HOST = re.compile(r"@[A-Za-z0-9-]+\.[A-Za-z]")
NAME_STOP = re.compile(r"[\s:@]")
TIGHTER = 0.3  # letters alone
MIN_ASSIGN, MIN_ACCESS = 8, 16


class TokenEfficiency:
    """Characters per token of a string under a tiktoken vocabulary."""

    def __init__(self, name: str, ranks: bytes, pattern: str):
        import base64

        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.coder = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> float:
        return len(text) / max(1, len(self.coder.encode_ordinary(text)))


_CODERS: dict[str, TokenEfficiency] = {}


def coder_of(ranks: bytes, pattern: str) -> TokenEfficiency:
    key = hashlib.sha1(ranks).hexdigest()
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = TokenEfficiency(key, ranks, pattern)
    return _CODERS[key]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def looks_random(run: str, efficiency: TokenEfficiency, limit: float) -> bool:
    if KNOWN.fullmatch(run):
        return False
    if run.isalpha():
        return efficiency(run) < limit and efficiency(run.lower()) < limit - TIGHTER
    return any(map(str.isdigit, run)) and efficiency(run) < limit


class Addresses:
    """Whether runs, asked for in text order, lie in an address; the text is gone over once, however long it is."""

    def __init__(self, text: str):
        self.text = text
        self.urls = URL.finditer(text)
        self.url = next(self.urls, None)
        self.at = text.find("@")        # the next @ after the last run
        self.login = self.mail = None   # last characters before it that end a login or a mail name
        self.host = False               # whether a mail host follows it
        self.seen, self.stop = 0, -1    # text gone over for the last of NAME_STOP, and its place

    def _next_at(self, b: int) -> bool:
        while -1 < self.at < b:
            self.at, self.login = self.text.find("@", max(b, self.at + 1)), None
        if self.at < 0:
            return False
        if self.login is None:
            self.login = max((m.start() for m in LOGIN_STOP.finditer(self.text, b, self.at)), default=-1)
            self.mail = max((m.start() for m in MAIL_STOP.finditer(self.text, b, self.at)), default=-1)
            self.host = MAIL_HOST.match(self.text, self.at) is not None
        return True

    def _password(self, a: int) -> bool:
        """Whether a colon, not that of mailto, is the last separator before the run."""
        for m in NAME_STOP.finditer(self.text, self.seen, a):
            self.stop = m.start()
        self.seen = max(self.seen, a)
        return self.stop >= 0 and self.text[self.stop] == ":" and not self.text.startswith("mailto", max(0, self.stop - 6))

    def hold(self, a: int, b: int) -> bool:
        """Whether the run lies in the host or path of a web address, or is the name in a mail address."""
        while self.url is not None and self.url.end() <= a:
            self.url = next(self.urls, None)
        at = self._next_at(b)
        if self.url is not None and self.url.start(1) <= a:
            return not (at and self.login < b)
        mail = at and self.host and (self.at == b or (self.text[b] == "." and self.mail < b))
        return mail and not self._password(a)


def random_spans(text: str, base: list[tuple[int, int, int]], efficiency: TokenEfficiency, limit: float) -> list[tuple[int, int, int]]:
    """Runs, or else segments of them, that the vocabulary spells inefficiently, outside base spans and known forms."""
    out, addresses = [], Addresses(text)
    starts = [a for a, _, _ in base]
    reach = list(itertools.accumulate((b for _, _, b in base), max))

    def in_base(a: int, b: int) -> bool:
        k = bisect.bisect_left(starts, b)
        return k > 0 and reach[k - 1] > a

    for m in RUN.finditer(text):
        run, a, b = m[0], m.start(), m.end()
        if KNOWN.fullmatch(run) or addresses.hold(a, b):
            continue
        if not run.isalpha() and not in_base(a, b) and looks_random(run, efficiency, limit):
            out.append((a, 3, b))
            continue
        for part in SEGMENT.finditer(run):
            c, d = a + part.start(), a + part.end()
            if not in_base(c, d) and looks_random(part[0], efficiency, limit):
                out.append((c, 3, d))
    return out


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(df: DataFrame, ranks_path: str, pattern: str, max_chars_per_token: float = 2.2, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """``(id_col, n_assign, n_access, n_hex, n_random, base, spans)`` of every row.

    ``base`` and ``spans`` list ``kind:start:end`` by start, then kind.
    """
    with open(ranks_path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        efficiency = coder_of(ranks.value, pattern)
        for d, raw in zip(batch.column(0).to_pylist(), common.byte_values(batch.column(1))):
            text = (raw or b"").decode()
            base = base_spans(text)
            more = random_spans(text, base, efficiency, max_chars_per_token)
            n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
            yield d, *n, len(more), span_text(base), span_text(base + more)

    rows = df.select(F.col(id_col), F.col(text_col).cast("string"))
    return common.row_map(rows, run, f"`{id_col}` {id_type}, n_assign long, n_access long, n_hex long, n_random long, base string, spans string",
                          size=lambda r: 64 + 2 * len(r[6]))
