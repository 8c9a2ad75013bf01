"""Secret scans: patterns, and character Markov models of random strings and ordinary identifiers."""

from __future__ import annotations

import random
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the base patterns
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "markov")
_ALPHABET = string.ascii_letters + string.digits + "+/_=-"
#: Documents whose words teach the model of ordinary identifiers: those with the smallest hashes.
TRAIN_DOCS = 500
#: Different words of theirs that it is made of at most, the most frequent first.
TRAIN_WORDS = 5000
#: Log-likelihood ratio that makes a candidate a secret, in nats for each character.
THRESHOLD = 0.9
#: Characters that a candidate has at least, and different ones among them (rows of dashes look random to the models).
LEAST_LENGTH, LEAST_DISTINCT = 16, 8
#: Means over fewer characters vary more: below this length the threshold grows as the square root of what is missing.
SURE_LENGTH = 20

_ORDINARY = """get set user name value index list item count size total file path open close read write page view model data table row column key
map filter sort merge join group order first last next prev start end begin stop error warning message handler event listener request response
header body content type length width height color style class object string number boolean integer float array buffer stream socket server
client config option param argument default result status code state update create delete insert select find search match replace parse format
print debug info trace log test check valid invalid enable disable active current previous internal external public private static final""".split()


#: Weight of the shorter context in a chain's estimates, in observations.
BACK_OFF = 6.0


@dataclass
class Models:
    """Log-likelihood ratios of the two chains."""

    start: np.ndarray  # of a first character
    second: np.ndarray  # of a second one after the first
    table: np.ndarray  # of each next one after two


def _encoded(s: str) -> np.ndarray:
    return np.array([_ALPHABET.find(c) for c in s if c in _ALPHABET], np.int64)


def _chain(sample: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probabilities of an order-2 Markov chain that backs off to orders 1 and 0."""
    n = len(_ALPHABET)
    first, one, two, three = np.ones(n), np.ones(n), np.zeros((n, n)), np.zeros((n, n, n))
    for s in sample:
        x = _encoded(s)
        if len(x):
            first[x[0]] += 1
            np.add.at(one, x, 1)
            np.add.at(two, (x[:-1], x[1:]), 1)
            np.add.at(three, (x[:-2], x[1:-1], x[2:]), 1)
    p1 = one / one.sum()
    p2 = (two + BACK_OFF * p1) / (two.sum(1, keepdims=True) + BACK_OFF)
    p3 = (three + BACK_OFF * p2[None]) / (three.sum(2, keepdims=True) + BACK_OFF)
    return np.log(first / first.sum()), np.log(p2), np.log(p3)


def trained(random_strings: list[str], ordinary: list[str]) -> Models:
    """Order-2 Markov models of both classes; what is kept is their log ratio."""
    noise, plain = _chain(random_strings), _chain(ordinary)
    return Models(*((a - b).astype(np.float32) for a, b in zip(noise, plain, strict=True)))


def ratio(models: Models, s: str) -> float:
    """Mean log-likelihood ratio for each character: positive where s looks random."""
    x = _encoded(s)
    if not len(x):
        return 0.0
    total = float(models.start[x[0]]) + (float(models.second[x[0], x[1]]) if len(x) > 1 else 0.0)
    return (total + float(models.table[x[:-2], x[1:-1], x[2:]].sum(dtype=np.float64))) / len(x)


def samples(words: list[str], n: int = 4000, seed: int = 11) -> tuple[list[str], list[str]]:
    """Labelled samples: random strings over common alphabets, and identifiers made of ordinary words."""
    rng = random.Random(seed)
    alphabets = [string.hexdigits[:16], string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "_-"]
    noise = ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(20, 48))) for _ in range(n)]
    plain = []
    pool = [w for w in words if re.fullmatch(r"[A-Za-z]+", w)] or _ORDINARY
    for i in range(n):
        own = [rng.choice(_ORDINARY if rng.random() < 0.5 else pool) for _ in range(rng.randint(2, 6))]
        shape = i % 6
        if shape == 0:
            plain.append("_".join(w.lower() for w in own))
        elif shape == 1:
            plain.append(own[0].lower() + "".join(w.capitalize() for w in own[1:]))
        elif shape == 2:
            plain.append("-".join(w.lower() for w in own) + rng.choice(["", "-" + str(rng.randint(0, 2030))]))
        elif shape == 3:
            plain.append("/".join(own))
        elif shape == 4:
            plain.append("_".join(w.upper() for w in own))
        else:
            plain.append("".join(w.lower() for w in own))
    return noise, plain


def learned(docs: DataFrame, text_col: str = "text", most_docs: int = TRAIN_DOCS, most_words: int = TRAIN_WORDS) -> Models:
    """Train on generated random strings and on identifiers made of the words of a bounded sample of documents.

    Words of four letters and more, without digits, from the most_docs texts with the smallest hashes; of these
    words the most_words that most of the texts hold.
    """
    own = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    last = own.select("h").distinct().orderBy("h").limit(most_docs).agg(F.max("h")).first()[0]  # hashes alone are gathered, not texts
    few = own.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.first("text").alias("text")) if last is not None else own.limit(0)
    words = few.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[A-Za-z]{4,24}\b"), F.lit(0)))).alias("w")).groupBy("w").count()
    rows = words.orderBy(F.desc("count"), "w").limit(most_words).collect()
    return trained(*samples([r["w"] for r in rows]))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def _candidates(least: int) -> re.Pattern:
    return re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{least},}}(?![A-Za-z0-9+/_=-])")


def asked(threshold: float, length: int) -> float:
    """The ratio that a candidate of so many characters must reach."""
    return threshold * max(1.0, SURE_LENGTH / length) ** 0.5


def added_spans(text: str, base: list[tuple[int, int, str]], models: Models, threshold: float, least: int = LEAST_LENGTH, distinct: int = LEAST_DISTINCT) -> list[tuple[int, int, str]]:
    """Candidates apart from all base spans whose log-likelihood ratio reaches the threshold for their length; digits alone are left out.

    A candidate is a whole run of letters, digits and +/_=- of at least `least` characters, `distinct` of them different.
    One that overlaps a base span is left out, as that span reports it.
    """
    out, at, reach = [], 0, 0
    base = sorted(base)
    for m in _candidates(least).finditer(text):
        while at < len(base) and base[at][0] < m.end():  # both lists rise, so each base span is looked at once
            reach = max(reach, base[at][1])
            at += 1
        s = m[0]
        if reach <= m.start() and len(set(s)) >= distinct and not s.isdigit() and ratio(models, s) >= asked(threshold, len(s)):
            out.append((m.start(), m.end(), "markov"))
    return out


RESULT = T.StructType([T.StructField("base", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("added", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])


def scanned(texts: Column, models: Models, threshold: float = THRESHOLD, least: int = LEAST_LENGTH, distinct: int = LEAST_DISTINCT) -> Column:
    """For each whole text a struct of base and added spans (kind, start, end; code points, end exclusive).

    Both lists are sorted by start, then kind in the order assign, access, hex, markov. Null and empty texts have none.
    Texts of any length are scanned whole, in time that grows with their length. Rows are scanned one by one, so repeated
    rows have the same spans and an empty table has none; a ratio of exactly the threshold is a secret. No column is named.
    """
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    @F.arrow_udf(RESULT)
    def scan(column: pa.Array) -> pa.Array:
        key = lambda x: (x[0], KINDS.index(x[2]))
        base, added = [], []
        for i in range(len(column)):
            text = column[i].as_py() or ""
            own = sorted(base_spans(text), key=key)
            base.append([{"kind": k, "start": a, "end": b} for a, b, k in own])
            added.append([{"kind": k, "start": a, "end": b} for a, b, k in added_spans(text, own, models, threshold, least, distinct)])
        return pa.StructArray.from_arrays([pa.array(base, pa.list_(item)), pa.array(added, pa.list_(item))], ["base", "added"])

    return scan(texts)


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each span replaced by the mask; overlapping spans are one. Null texts stay null, null spans are none; any length goes."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, ss in zip(texts.to_pylist(), found.to_pylist(), strict=True):
            if t is not None:
                parts, at = [], 0
                for s in sorted(ss or [], key=lambda s: (s["start"], -s["end"])):
                    if s["end"] <= at:
                        continue
                    if s["start"] >= at:
                        parts += [t[at : s["start"]], mask]
                    at = s["end"]
                t = "".join([*parts, t[at:]])
            out.append(t)
        return pa.array(out, pa.string())

    return cut(text, spans)
