"""Secret scans: pattern matches, and credential values judged by what they cost to guess.

Every value in a credential context, those of the patterns included, is segmented at least
total cost, in bits, into words of a ranked list, dates, repeats, sequences, keyboard walks and
brute-force spans, by dynamic programming over its characters. Values that cost at least
``least_bits`` are spans of kind ``guess``; the pattern matches stay as they are, whatever
their values cost.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import top, whole, words, written

#: Fixed values of the contract, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "guess")
#: Where the method looks for values, wider than the patterns above.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|private|auth)[_-]?key|bearer|login)["']?\x20*(?:[:=]|=>)?\x20*["']?([^\s"'<>]{8,})""", re.I | re.A
)
HINT = re.compile(r"pass|pwd|secret|token|credential|key|bearer|login", re.I | re.A)
#: Common passwords, most common first; rows of a keyboard.
COMMON = "password qwerty admin welcome letmein dragon monkey football baseball master login princess sunshine shadow superman secret test guest changeme example default root user hello abc love iloveyou trustno starwars whatever freedom".split()
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
LEET = str.maketrans("4301$5@7", "aeoissat")
DATE = re.compile(r"(?:19|20)\d\d[-./_]?(?:0[1-9]|1[0-2])[-./_]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-./_]?(?:0[1-9]|1[0-2])[-./_]?(?:19|20)\d\d|(?:19|20)\d\d")
NEAR = {(a, b) for row in ROWS for a, b in zip(row, row[1:])} | {(b, a) for row in ROWS for a, b in zip(row, row[1:])}
LONGEST_WORD, SEGMENT_BITS = 24, 1.0


def _per_char(value: str) -> float:
    size = 10 * any(c.isdigit() for c in value) + 26 * any("a" <= c <= "z" for c in value) + 26 * any("A" <= c <= "Z" for c in value)
    size += 33 * any(c.isascii() and not c.isalnum() for c in value) + 100 * (not value.isascii())
    return math.log2(max(size, 2))


def segments(value: str, ranks: dict[str, int]) -> list[tuple[int, int, float, str]]:
    """(start, end, bits, kind) of every cheap span of a value."""
    low, n, found = value.lower(), len(value), []
    plain = low.translate(LEET)
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            for text, extra in ((low, 0.0), (plain, 1.5)):
                rank = ranks.get(text[i:j])
                if rank:
                    case = 0.0 if value[i:j] == low[i:j] else 1.0 if value[i:j].istitle() or value[i:j].isupper() else 3.0
                    found.append((i, j, math.log2(rank) + extra + case + 0.5, "word"))
                    break
    for m in DATE.finditer(value):
        found.append((m.start(), m.end(), math.log2(365 * 60 if m.end() - m.start() > 4 else 60), "date"))
    for kind, joined in (
        ("repeat", lambda a, b: a == b),
        ("sequence", lambda a, b: ord(b) - ord(a) == 1),
        ("sequence", lambda a, b: ord(a) - ord(b) == 1),
        ("walk", lambda a, b: (a, b) in NEAR),
    ):
        i = 0
        while i < n:
            j = i + 1
            while j < n and joined(low[j - 1], low[j]):
                j += 1
            if j - i >= 3:
                bits = 6.0 + math.log2(j - i) if kind != "walk" else 6.0 + 0.9 * (j - i)
                found.append((i, j, bits, kind))
            i = j
    for size in range(2, min(16, n // 2) + 1):  # a block that repeats costs the block and a count
        i = 0
        while i + 2 * size <= n:
            k = 1
            while value[i + k * size : i + (k + 1) * size] == value[i : i + size]:
                k += 1
            if k >= 2:
                found.append((i, i + k * size, _per_char(value[i : i + size]) * size + math.log2(k), "repeat"))
                i += k * size
            else:
                i += 1
    return found


def guess_bits(value: str, ranks: dict[str, int]) -> float:
    """Least bits over all segmentations: cost[j] = min over spans (i, j) of cost[i] + bits."""
    each, ends = _per_char(value), {}
    for i, j, bits, _ in segments(value, ranks):
        ends.setdefault(j, []).append((i, bits + SEGMENT_BITS))
    cost = [0.0]
    for j in range(1, len(value) + 1):
        cost.append(min([cost[j - 1] + each, *(cost[i] + bits for i, bits in ends.get(j, ()))]))
    return cost[-1]


def values(text: str) -> list[tuple[int, int]]:
    """(start, end) of every credential value of a text: of the assign pattern and of the wider contexts."""
    found = {m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 12}
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".,;:!?)]}")
        if len(value) >= 8:
            found.add((m.start(1), m.start(1) + len(value)))
    return sorted(found)


def scan(text: str, ranks: dict[str, int], least_bits: float) -> tuple[list[tuple[int, int, int]], float]:
    """(start, kind index, end) by start and kind; the bits of the dearest credential value (0.0: none)."""
    found, most = [], 0.0
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if HINT.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        for start, end in values(text):
            bits = guess_bits(text[start:end], ranks)
            most = max(most, bits)
            if bits >= least_bits:
                found.append((start, 3, end))
    return sorted(found), most


SCANNED = T.StructType().add("n_assign", "long").add("n_access", "long").add("n_hex", "long").add("n_guess", "long").add("base", "string").add("spans", "string").add("most_bits", "double")


def ranked_words(docs: DataFrame, most: int = 20000, least: int = 3) -> list[str]:
    """The corpus's ``most`` most frequent words of 3 to 24 letters that occur ``least`` times or more.

    Counted over whole texts of all documents; a ranked list is what a guesser tries first, and
    rarer words cost their letters.
    """
    word = F.explode(words(F.regexp_replace(F.lower(whole("text")), r"[^\p{L}\x20\x09-\x0D]+", " ")))
    counts = docs.select(word.alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.filter((F.col("n") >= least) & F.length("w").between(3, LONGEST_WORD))
    rows = top(written(counts, "words"), "n", most, "w").collect()
    return [r.w for r in sorted(rows, key=lambda r: (-r.n, r.w))]


def find_secrets(docs: DataFrame, least_bits: float = 50.0, lexicon: list[str] | None = None) -> DataFrame:
    """documents -> doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans, most_bits.

    ``spans`` lists kind:start:end in code points by start, then kind; ``most_bits`` is what the
    dearest credential value of the text costs, 0 where it has none. Null text is empty and has
    no spans; repeated rows are scanned each; an empty table gives no rows; columns other than
    doc_id and text are not looked at. Costs grow with a value's length, however long it is.
    ``lexicon`` is the ranked word list, from the corpus itself where it is not given.
    """
    lexicon = COMMON + (ranked_words(docs) if lexicon is None else lexicon)
    ranks = docs.sparkSession.sparkContext.broadcast({w: i + 1 for i, w in reversed(list(enumerate(lexicon)))})

    @F.pandas_udf(SCANNED)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                found, most_bits = scan(text or "", ranks.value, least_bits)
                named = [f"{KINDS[k]}:{s}:{e}" for s, k, e in found]
                n = [sum(k == kind for _, k, _ in found) for kind in range(4)]
                base = ",".join(x for x, f in zip(named, found) if f[1] < 3)
                rows.append((*n, base, ",".join(named), most_bits))
            yield pd.DataFrame(rows, columns=SCANNED.names)

    s = docs.select("doc_id", scanned(whole("text")).alias("s")).select("doc_id", "s.*")
    return s.withColumn("base_sha256", F.sha2("base", 256)).drop("base")
