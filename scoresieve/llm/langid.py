"""Language identification: script ranges narrow the candidates, Viterbi labels spans."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import stored

#: Hash range of letter trigrams (word edges included).
RANGE = 1 << 16
#: Documents to learn from, for each language: those with the smallest hashes of their ids.
TRAIN_PER_LANG = 2000
#: Languages whose document counts may be broadcast.
BROADCAST_LANGS = 10_000
#: Nats that a change of language between two words costs.
SWITCH = 8.0
#: Code points handled at once.
CHUNK = 1 << 19
UNKNOWN = "und"

#: First code points of ranges of scripts. (fixed values: Unicode blocks)
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"),
    (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x323B0, "other"),
]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # log probability of each trigram under each language, minus the mean over languages
    allowed: np.ndarray  # script by language: 0 where the language is written in the script, else a large negative number


#: Code points that have letters: planes 0 to 3.
POINTS = 0x40000


class Letters:
    """Letters of texts as lower-case code points, and their words: runs of letters and combining marks that begin with a letter."""

    def __init__(self):
        kind = [unicodedata.category(chr(i))[0] for i in range(POINTS)]
        self.letter = np.array([k == "L" for k in kind])
        self.mark = np.array([k == "M" for k in kind])
        self.lower = np.arange(POINTS, dtype=np.uint32)
        for i in np.flatnonzero(self.letter[:0x20000]):
            low = chr(i).lower()
            self.lower[i] = ord(low) if len(low) == 1 else i
        self.starts = np.array([a for a, _ in SCRIPTS], np.uint32)
        self.names = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS], np.int16)

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Trigram hash at each letter, where words start among the letters, each word's script, and its start and end in the text."""
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = np.where(c < POINTS, c, 0)
        is_letter = self.letter[low]
        mark = self.mark[low]
        if mark.any():  # a mark belongs to the word of the letter before it, with other marks between them
            at = np.maximum.accumulate(np.where(mark, -1, np.arange(len(c))))
            is_letter = is_letter | (mark & (at >= 0) & is_letter[np.maximum(at, 0)])
        code = np.where(is_letter, self.lower[low], 0).astype(np.uint32)
        padded = np.zeros(len(c) + 2, np.uint32)
        padded[1:-1] = code
        h = (padded[:-2] * np.uint32(0x9E3779B1)) ^ (padded[1:-1] * np.uint32(0x85EBCA6B)) ^ (padded[2:] * np.uint32(0xC2B2AE35))
        h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
        at = np.flatnonzero(is_letter)
        if not len(at):
            e = np.zeros(0, np.int64)
            return e, e, e, e, e
        first = np.r_[True, at[1:] != at[:-1] + 1]
        begin = np.flatnonzero(first)
        starts = at[begin]
        ends = at[np.r_[begin[1:] - 1, len(at) - 1]] + 1
        script = self.names[np.searchsorted(self.starts, c[starts], "right") - 1]
        return h[at].astype(np.int64), begin, script, starts, ends


def _counts(batches):
    """How often each trigram, and each script's words, occur in each language's documents."""
    letters, total = Letters(), {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h, _, script, _, _ = letters.words(text or "")
            own = total.setdefault(lang, np.zeros(RANGE + len(SCRIPT_NAMES), np.int64))
            np.add.at(own, h, 1)
            np.add.at(own, RANGE + script.astype(np.int64), 1)
    for lang, own in total.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at], pa.int64())], ["lang", "feature", "n"])


def learned(docs: DataFrame, trains: Column, per_lang: int = TRAIN_PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from at most about per_lang documents of each language, chosen by a hash of id and text; null languages are left out.

    Only sums of trigram and script counts reach the driver: RANGE numbers for each language at most.
    """
    own = docs.where(F.col(lang_col).isNotNull() & trains)
    n = own.groupBy(lang_col).count().select(F.col(lang_col).alias("_lang"), F.col("count").alias("_n"))
    draw = F.pmod(F.xxhash64(F.lit("langid"), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    n = stored(n, "langs")
    few = n.count() <= BROADCAST_LANGS
    sample = own.join(F.broadcast(n) if few else n, own[lang_col] == n["_lang"]).where(draw < F.lit(float(per_lang)) / F.col("_n")).select(F.col("_lang").alias("lang"), F.col(text_col).alias("text"))
    sums = sample.mapInArrow(_counts, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    names = np.asarray(sums.column("lang").to_pylist(), object)
    langs = sorted(set(names))
    counts = np.zeros((len(langs), RANGE + len(SCRIPT_NAMES)))
    place = {lang: i for i, lang in enumerate(langs)}
    counts[[place[x] for x in names], np.asarray(sums.column("feature"))] = np.asarray(sums.column("n"))
    grams, scripts = counts[:, :RANGE] + 0.1, counts[:, RANGE:]
    table = np.log(grams / grams.sum(1, keepdims=True)).T if langs else np.zeros((RANGE, 0))
    share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
    allowed = np.where(share >= 0.005, 0.0, -100.0).T if langs else np.zeros((len(SCRIPT_NAMES), 0))
    if langs:
        table = table - table.mean(1, keepdims=True)
    return Model(langs, table.astype(np.float32), allowed.astype(np.float32))


def _viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word; scores holds the words of all documents one after the other."""
    k = scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    offset = np.r_[0, np.cumsum(lengths)][:-1][order]
    active = np.searchsorted(-lengths[order], -np.arange(1, int(lengths.max(initial=0)) + 1), "right")  # documents with more than t words
    back = np.empty(scores.shape, np.int8 if k < 128 else np.int16)
    state = np.zeros((len(lengths), k), np.float32)
    for t, n in enumerate(active):
        at = offset[:n] + t
        now = state[:n]
        if t:
            best = now.argmax(1)
            top = now[np.arange(n), best] - np.float32(switch)
            stay = now >= top[:, None]
            back[at] = np.where(stay, np.arange(k), best[:, None])
            now = np.where(stay, now, top[:, None])
        state[:n] = now + scores[at]
    label = np.empty(len(scores), np.int16)
    current = state.argmax(1) if k else np.zeros(len(lengths), int)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = offset[:n] + t
        label[at] = current[:n]
        if t:
            current[:n] = back[at, current[:n]]
    return label


RESULT = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())]))),
])


def _labelled(texts: list[str], letters: Letters, model: Model, switch: float) -> list[dict]:
    table, allowed = model.table, model.allowed
    found, lengths, scripts, places, sizes = [], [], [], [], []
    for text in texts:
        h, begin, script, starts, ends = letters.words(text)
        scores = np.zeros((len(begin), len(model.langs)), np.float32)
        step = max(1, (8 << 20) // max(1, len(model.langs)))
        for at in range(0, len(begin), max(1, step // 16)):  # a long text in parts
            to = min(at + max(1, step // 16), len(begin))
            part = h[begin[at] : begin[to] if to < len(begin) else len(h)]
            scores[at:to] = np.add.reduceat(table[part], begin[at:to] - begin[at], axis=0)
        found.append(scores)
        lengths.append(len(begin))
        scripts.append(script)
        places.append((starts, ends))
        sizes.append(len(h))
    scores = np.concatenate(found)
    script = np.concatenate(scripts).astype(np.int64)
    open_to = allowed[script]
    known = (open_to == 0).any(1) if len(model.langs) else np.zeros(len(script), bool)
    scores += np.where(known[:, None], open_to, 0)
    labels = _viterbi(scores, np.asarray(lengths), switch)
    out, at = [], 0
    for n, (starts, ends) in zip(lengths, places, strict=True):
        own = labels[at : at + n]
        at += n
        if not n or not model.langs:
            out.append({"lang": UNKNOWN, "score": 0.0, "spans": []})
            continue
        by_lang = np.bincount(own, weights=ends - starts, minlength=len(model.langs))
        best = int(by_lang.argmax())
        cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        last = np.r_[cut[1:] - 1, n - 1]
        spans = [{"start": int(starts[i]), "end": int(ends[j]), "lang": model.langs[own[i]]} for i, j in zip(cut, last, strict=True)]
        out.append({"lang": model.langs[best], "score": float(by_lang[best] / by_lang.sum()), "spans": spans})
    return out


def identified(texts: Column, model: Model, switch: float = SWITCH) -> Column:
    """For each whole text a struct of lang, score (share of its letters labelled so) and spans (start, end, lang; code points).

    ``und`` where a text is null or has no letter. A word whose script no learned language uses is scored by all of them.
    Ties go to the first language in order. Without any learned language every text is ``und``. Combining marks belong to
    the word of the letter before them. Texts of any length are labelled whole. Rows are labelled one by one, so repeated
    rows agree and an empty table gives none; no column is named.
    """
    known: list[Letters] = []

    @F.arrow_udf(RESULT)
    def label(column: pa.Array) -> pa.Array:
        if not known:  # once for each task
            known.append(Letters())
        letters, out, group, size = known[0], [], [], 0
        for i in range(len(column)):
            text = column[i].as_py() or ""
            group.append(text)
            size += len(text)
            if size >= CHUNK or i == len(column) - 1:
                out += _labelled(group, letters, model, switch)
                group, size = [], 0
        langs = pa.array([x["lang"] for x in out], pa.string())
        spans = pa.array([x["spans"] for x in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))
        return pa.StructArray.from_arrays([langs, pa.array([x["score"] for x in out], pa.float64()), spans], ["lang", "score", "spans"])

    return label(texts)
