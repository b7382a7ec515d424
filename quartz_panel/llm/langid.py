"""Language identification: script ranges, word scores, and Viterbi over the words of a text.

Training is one Spark aggregation: hashed character 3-grams of words are counted by language, into a
table of fixed size (languages x 2**bits), and so are the scripts of words.  A word's score in a
language is the sum of its 3-grams' log-likelihoods; a script that a language hardly uses rules the
language out for the word.  Viterbi with a penalty for each switch labels runs of words, so a text in
two languages gives two spans and single odd words don't.  A document's language is that of most of
its letters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import mix

#: Cells (languages x buckets) of the score table: with more languages than fit at the asked number of bits, grams share buckets.
MOST_CELLS = 1 << 24
LEAST_BITS = 8
#: Languages whose counts a task holds at once, and cells of word scores that a task makes at once.
HELD_LANGUAGES = 64
WORD_CELLS = 1 << 22

#: First code points of ranges, and the script of each range.
RANGES = [
    (0x0, "other"), (0x41, "latin"), (0x5B, "other"), (0x61, "latin"), (0x7B, "other"), (0xAA, "latin"), (0xAB, "other"), (0xB5, "latin"), (0xB6, "other"), (0xBA, "latin"),
    (0xBB, "other"), (0xC0, "latin"), (0xD7, "other"), (0xD8, "latin"), (0xF7, "other"), (0xF8, "latin"), (0x2C2, "other"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"),
    (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"), (0x900, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB07, "other"), (0x20000, "han"), (0x30000, "other"),
]
#: First and last code points of further blocks, and their scripts.  Any other letter is of the script "rest".
BLOCKS = [
    (0x700, 0x74F, "syriac"), (0x750, 0x77F, "arabic"), (0x780, 0x7BF, "thaana"), (0x7C0, 0x7FF, "nko"), (0x860, 0x86F, "syriac"), (0x870, 0x8FF, "arabic"), (0xE80, 0xEFF, "lao"),
    (0xF00, 0xFFF, "tibetan"), (0x1000, 0x109F, "myanmar"), (0x1200, 0x139F, "ethiopic"), (0x13A0, 0x13FF, "cherokee"), (0x1400, 0x167F, "canadian"), (0x1780, 0x17FF, "khmer"),
    (0x1800, 0x18AF, "mongolian"), (0x18B0, 0x18FF, "canadian"), (0x1C80, 0x1C8F, "cyrillic"), (0x1C90, 0x1CBF, "georgian"), (0x1D00, 0x1DBF, "latin"), (0x2C60, 0x2C7F, "latin"),
    (0x2D00, 0x2D2F, "georgian"), (0x2D80, 0x2DDF, "ethiopic"), (0x2DE0, 0x2DFF, "cyrillic"), (0x3005, 0x3007, "han"), (0x3100, 0x312F, "bopomofo"), (0x3130, 0x318F, "hangul"),
    (0x31A0, 0x31BF, "bopomofo"), (0x31F0, 0x31FF, "kana"), (0xA000, 0xA4CF, "yi"), (0xA640, 0xA69F, "cyrillic"), (0xA720, 0xA7FF, "latin"), (0xA8E0, 0xA8FF, "indic"),
    (0xA960, 0xA97F, "hangul"), (0xA9E0, 0xA9FF, "myanmar"), (0xAA60, 0xAA7F, "myanmar"), (0xAB00, 0xAB2F, "ethiopic"), (0xAB30, 0xAB6F, "latin"), (0xAB70, 0xABBF, "cherokee"),
    (0xFB13, 0xFB17, "armenian"), (0xFB1D, 0xFB4F, "hebrew"), (0xFB50, 0xFDFF, "arabic"), (0xFE70, 0xFEFF, "arabic"), (0xFF21, 0xFF5A, "latin"), (0xFF66, 0xFF9F, "kana"),
    (0xFFA0, 0xFFDC, "hangul"), (0x1B000, 0x1B16F, "kana"), (0x30000, 0x323AF, "han"),
]
#: Blocks of marks and selectors that belong to no script.
NO_SCRIPT = [(0x300, 0x36F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE00, 0xFE0F), (0xFE20, 0xFE2F), (0xE0100, 0xE01EF)]
SCRIPTS = sorted({s for *_, s in RANGES} | {s for *_, s in BLOCKS} | {"rest"})
_OTHER = SCRIPTS.index("other")


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its script ("other" unless a letter, or a mark of a script), and whether it is a letter."""
    kind = np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(0x110000)).encode(), "S1")
    letter, mark = kind == b"L", kind == b"M"
    starts = np.array([a for a, _ in RANGES])
    script = np.array([SCRIPTS.index(s) for _, s in RANGES], np.int8)[np.searchsorted(starts, np.arange(0x110000), "right") - 1]
    for a, b, name in BLOCKS:
        script[a : b + 1] = SCRIPTS.index(name)
    script[(script == _OTHER) & (letter | mark)] = SCRIPTS.index("rest")
    for a, b in NO_SCRIPT:
        script[a : b + 1] = _OTHER
    script[~letter & ~mark] = _OTHER
    return script, letter


_SCRIPT, _LETTER = _tables()


@dataclass
class Model:
    languages: list[str]
    bits: int
    scores: np.ndarray  # 2**bits x languages, float32 log-likelihoods
    allowed: np.ndarray  # scripts x languages


def _letters(texts: list[str], bits: int):
    """For the concatenated texts: script of each word, its text, its grams' buckets and their word."""
    joined = "\n".join(texts).lower() + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    script = _SCRIPT[codes]
    solid = script != _OTHER
    before = np.zeros_like(solid)
    before[1:] = solid[:-1] & (script[1:] == script[:-1])
    starts = np.flatnonzero(solid & ~before)
    after = np.zeros_like(solid)
    after[:-1] = solid[1:] & (script[1:] == script[:-1])
    ends = np.flatnonzero(solid & ~after) + 1
    # marks alone are no word
    letters = np.concatenate([[0], np.cumsum(_LETTER[codes])])
    for a, b in np.stack([starts, ends], 1)[letters[ends] == letters[starts]]:
        solid[a:b] = False
    worded = letters[ends] > letters[starts]
    starts, ends = starts[worded], ends[worded]
    line = np.cumsum(codes == 10)
    # the lower-cased form of a text has as many lines as the text; texts' lines add up
    per_text = np.array([t.count("\n") + 1 for t in texts], np.int64)
    text_of = np.searchsorted(np.cumsum(per_text), line[starts], "right") if len(starts) else np.zeros(0, np.int64)
    c = np.where(solid, codes, 0).astype(np.uint64)
    left, right = np.zeros_like(c), np.zeros_like(c)
    left[1:], right[:-1] = c[:-1], c[1:]
    left[starts], right[ends - 1] = 1, 1
    place = np.flatnonzero(solid)
    grams = (mix((left[place] << np.uint64(42)) | (c[place] << np.uint64(21)) | right[place]) >> np.uint64(64 - bits)).astype(np.int64)
    return script[starts], text_of, starts, ends, grams, ends - starts


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _gram_counts(batches: Iterator[pa.RecordBatch], bits: int, group: int = 400) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}

    def flushed():
        for lang, held in counts.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(held[at], pa.int64())], names=["lang", "bucket", "n"])
        counts.clear()

    for batch in batches:
        for lo in range(0, batch.num_rows, group):
            langs = batch.column(0).slice(lo, group).to_pylist()
            texts = [t or "" for t in batch.column(1).slice(lo, group).to_pylist()]
            for lang in sorted(set(langs)):
                if lang not in counts and len(counts) == HELD_LANGUAGES:
                    yield from flushed()
                script, _, _, _, grams, _ = _letters([t for x, t in zip(langs, texts, strict=True) if x == lang], bits)
                held = counts.setdefault(lang, np.zeros((1 << bits) + len(SCRIPTS), np.int64))
                held[: 1 << bits] += np.bincount(grams, minlength=1 << bits)
                held[1 << bits :] += np.bincount(script, minlength=len(SCRIPTS))
    yield from flushed()


def table_bits(n_languages: int, bits: int) -> int:
    """The asked bits while the table stays within MOST_CELLS (512 languages at 15 bits); fewer for more languages, never under LEAST_BITS."""
    while bits > LEAST_BITS and n_languages << bits > MOST_CELLS:
        bits -= 1
    return bits


def train(docs: DataFrame, bits: int = 15) -> Model:
    """Counts over all rows of ``docs`` whose lang isn't null; the driver gets at most languages x (2**bits + scripts) numbers.

    Any number of languages is learned; see ``table_bits`` for the table's size.  Without rows the model knows no language."""
    languages = sorted(r[0] for r in docs.filter("lang is not null").select("lang").distinct().collect())
    bits = table_bits(len(languages), bits)
    counts = docs.filter("lang is not null").select("lang", "text").mapInArrow(lambda b: _gram_counts(b, bits), "lang string, bucket int, n long")
    table = np.zeros(((1 << bits) + len(SCRIPTS), len(languages)))
    got = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    if got.num_rows:
        place = {x: i for i, x in enumerate(languages)}
        column = np.array([place[x] for x in got["lang"].unique().to_pylist()])[got["lang"].dictionary_encode().combine_chunks().indices.to_numpy(zero_copy_only=False)]
        table[got["bucket"].to_numpy(), column] = got["n"].to_numpy()
    grams, scripts = table[: 1 << bits], table[1 << bits :]
    likely = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * len(grams)))
    allowed = scripts >= 0.001 * np.maximum(scripts.sum(0), 1)
    return Model(languages, bits, (likely - likely.max(1, keepdims=True)).astype(np.float32) if languages else likely.astype(np.float32), allowed)


def viterbi(scores: np.ndarray, text_of: np.ndarray, n_texts: int, penalty: float) -> np.ndarray:
    """The label of each word: the best path of each text, a switch costing ``penalty``.  All texts advance together."""
    first = np.searchsorted(text_of, np.arange(n_texts + 1))
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    steps, k = int(size.max(initial=0)), scores.shape[1]
    back = np.zeros((len(scores), k), np.int16 if k < 1 << 15 else np.int32)
    value = np.zeros((n_texts, k), np.float64)
    live = np.searchsorted(-size[order], -np.arange(steps), "left")  # texts with more than t words
    same = np.arange(k)
    for t in range(steps):
        at = order[: live[t]]
        word = first[at] + t
        v = value[at]
        best = v.argmax(1)
        top = v[np.arange(len(at)), best][:, None] - penalty
        stay = v >= top
        back[word] = np.where(stay, same, best[:, None])
        value[at] = np.where(stay, v, top) + scores[word]
    out = np.zeros(len(scores), back.dtype)
    now = value.argmax(1)
    for t in range(steps - 1, -1, -1):
        at = order[: live[t]]
        word = first[at] + t
        out[word] = now[at]
        now[at] = back[word, now[at]]
    return out


def _word_scores(model: Model, grams: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each word's score by language, a stretch of words at a time, so that the letters' scores aren't all held at once."""
    ends = np.cumsum(size)
    out = np.empty((len(size), len(model.languages)))
    lo, step = 0, max(1, WORD_CELLS // len(model.languages))
    while lo < len(size):
        first = ends[lo] - size[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, first + step, "right")))
        out[lo:hi] = np.add.reduceat(model.scores[grams[first : ends[hi - 1]]], ends[lo:hi] - size[lo:hi] - first, axis=0)
        lo = hi
    return out


def _labelled(batches: Iterator[pa.RecordBatch], model: Model, penalty: float, spans: bool, group: int = 200) -> Iterator[pa.RecordBatch]:
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())]))
    k = len(model.languages)
    group = max(1, min(group, 64 * group // max(k, 1)))
    for batch in batches:
        for lo in range(0, batch.num_rows, group):
            texts = [t or "" for t in batch.column(1).slice(lo, group).to_pylist()]
            n = len(texts)
            script, text_of, _, _, grams, size = _letters(texts, model.bits)
            found, score, runs = ["und"] * n, np.zeros(n), [[] for _ in range(n)]
            if k and len(size):
                words = _word_scores(model, grams, size)
                fits = model.allowed[script]
                words -= 50.0 * (~fits & fits.any(1, keepdims=True))
                label = viterbi(words, text_of, n, penalty)
                letters = np.bincount(text_of * k + label, weights=size, minlength=n * k).reshape(n, k)
                total = letters.sum(1)
                for i in np.flatnonzero(total):
                    best = int(letters[i].argmax())
                    found[i], score[i] = model.languages[best], letters[i, best] / total[i]
                if spans:
                    cut = np.flatnonzero((np.diff(text_of, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0))
                    base = np.searchsorted(text_of, np.arange(n))
                    for a, b in zip(cut, [*cut[1:], len(label)], strict=True):
                        i = text_of[a]
                        runs[i].append({"lang": model.languages[label[a]], "first_word": int(a - base[i]), "end_word": int(b - base[i])})
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, group), pa.array(found, pa.string()), pa.array(score, pa.float64()), pa.array(runs, span_type)], names=["doc_id", "lang_pred", "score", "spans"])


def identify(docs: DataFrame, model: Model, penalty: float = 12.0, spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score (share of letters in that language), spans (lang, first and end word); a row for each row.

    Words are runs of letters (Unicode category L) and marks of one script.  A null text, or one without a letter, is ``und`` with
    score 0.  Of languages with equally many letters the first in alphabetical order is given.  The model is sent
    to the tasks: languages x 2**bits x 4 bytes.  Other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: _labelled(batches, held.value, penalty, spans), "doc_id long, lang_pred string, score double, spans array<struct<lang:string,first_word:long,end_word:long>>"
    )
