"""The language of each document, or of each stretch of one that mixes languages, whatever its label says.

Documents are cleared of code blocks, prompts and indented lines and cut into sentences; tokens that hold anything but letters
between their outer punctuation (paths, identifiers, calls, numbers, bracketed tags) say nothing. A sentence is the mean of its
words' vectors of hashed letter groups. A hierarchy of linear support vector machines decides: first the language family, then,
by one-versus-one votes, the language within it. Sentences that say too little take the language of their neighbours;
consecutive sentences of one language form a stretch.

As everything is linear, the margins of a token are computed once per task (hashing all new words of a batch at once) and
looked up afterwards; sentences are sums of looked-up rows, and votes are taken for all sentences of a batch at once.

The machines are fitted twice: on the labelled samples, and again with sentences of labelled documents for which the first
machines agree with the label. Both are bounded samples by hash (`ROWS` sentences, `DOCS` documents of up to `DOC_CHARS`
characters); documents are all classified, in whole. A quarter of the drawn documents is kept out of the fit to calibrate the
confidence: the slope of the logistic curve over the margins that makes their labels likeliest, allowing for wrong labels.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.session import spread

ROWS, DIMS = 1_200, 1 << 13
#: Labelled documents the second fit draws sentences from, and the longest of them in characters.
DOCS, DOC_CHARS = 2_000, 4_000
FAMILIES = {"germanic": ("en", "de", "nl"), "romance": ("fr", "es", "pt", "it"), "slavic": ("pl",)}
#: Other ways to write a language: ISO 639-2 codes, English and own names.
NOTATIONS = {
    "en": "en eng english englisch anglais", "de": "de ger deu german deutsch", "nl": "nl nld dut dutch nederlands flemish", "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano", "pt": "pt por portuguese português portugues", "it": "it ita italian italiano", "pl": "pl pol polish polski",
}
MISSING = ("", "unknown", "und", "n/a", "na", "none", "null", "mul", "zxx", "other", "?", "-", "xx")

_FENCE = re.compile(r"```[^\x00]*?(?:```|\x00|\Z)")
#: Lines that are code by their shape: indented, after a prompt, or ending in what ends statements and blocks.
_CODE_LINE = re.compile(r"^(?:(?: {4}|\t|[$%>] ?\$ |\$ ).*|.*[;{}][ \t]*)$", re.M)
_END = re.compile(r"(?<=[.!?…])[\"'»”)]*\s+|\n+|(?<=:)\s+(?=[\"„“«])|\x00")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*['’]?")
_OUTER = "\"'“”„«»‘’‚‹›()*.,;:!?¿¡…-–—·•|<>[]{}"
_PAIRS = {"[": "]", "<": ">", "{": "}", "`": "`"}
#: Slope of the logistic curve by which a sentence counts as decided, and of the confidence until it is calibrated; sentences
#: that calibration needs.
SLOPE, HELD = 4.0, 100
#: Characters of texts that are worked on at once.
CHUNK = 1 << 21


def code(label: Column) -> Column:
    """ISO 639-1 code of a label in any notation; the label itself, lower-cased, if it is none of ours; null if it says nothing."""
    text = F.lower(F.trim(label))
    head = F.split(text, r"[-_ ]")[0]
    known = [F.when(head.isin(*names.split()), F.lit(c)) for c, names in NOTATIONS.items()]
    return F.when(label.isNull() | text.isin(*MISSING), None).otherwise(F.coalesce(*known, text))


def _blank(m: re.Match) -> str:
    """As many characters that end a sentence; the mark between two texts is kept."""
    size = len(m[0])
    return "\n" * size if not m[0].endswith("\x00") else "\n" * (size - 1) + "\x00"


def _ranges(joined: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what lies between sentence ends, in a text or in several that are joined by a zero character."""
    ends = [m.span() for m in _END.finditer(joined)]
    at = np.array(ends, np.int64).reshape(-1, 2)
    return np.concatenate([[0], at[:, 1]]), np.concatenate([at[:, 0], [len(joined)]])


def _cleared(joined: str) -> str:
    if "```" in joined:
        joined = _FENCE.sub(_blank, joined)
    return _CODE_LINE.sub(_blank, joined.replace("\x00", "\n\x00\n")).replace("\n\x00\n", "\x00")


def sentences(text: str) -> list[tuple[int, int]]:
    """Ranges of a text's sentences, without code, prompts and the like."""
    clear = _cleared(text.replace("\x00", " "))
    return [(int(a), int(b)) for a, b in zip(*_ranges(clear), strict=True) if clear[a:b].strip()]


def token_words(token: str) -> list[str]:
    """The words of a token between blanks, in lower case; none if it is no natural language."""
    if _PAIRS.get(token[0]) == token.rstrip(",.:;")[-1:] and len(token) > 2:
        return []
    inner = token.strip(_OUTER)
    return [w.lower() for w in _WORD.findall(inner)] if inner and _TOKEN.fullmatch(inner) else []


def words(text: str) -> list[str]:
    return [w for t in text.split() for w in token_words(t)]


def plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).replace("ł", "l").replace("Ł", "L")


def letters(ws: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, place, value) of the hashed letter groups of words, sorted by word; each word's values have length 1.

    Groups are the runs of one to four letters of the word between its two ends, and the word as a whole, twice.
    """
    points = np.frombuffer("".join(f"<{w}>" for w in ws).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in ws], np.int64)
    of = np.repeat(np.arange(len(ws)), size)
    mul = np.uint64(0x9E3779B97F4A7C15)
    who, code = [], []
    h = np.zeros(len(points), np.uint64)
    for n in range(1, 5):
        if len(points) < n:
            break
        h = h[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(n)
        ok = of[: len(h)] == of[n - 1 :]
        who.append(of[: len(h)][ok])
        code.append(h[ok])
    if len(ws):
        start = np.cumsum(size) - size
        spread_ = points * (np.arange(len(points), dtype=np.uint64) - np.repeat(start, size).astype(np.uint64) + np.uint64(1)) * mul
        whole = np.add.reduceat(spread_ ^ (spread_ >> np.uint64(31)), start)
        who += [np.arange(len(ws))] * 2
        code += [whole] * 2
    if not who:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    mixed = np.concatenate(code) * mul
    place = ((mixed ^ (mixed >> np.uint64(29))) * mul >> np.uint64(40)).astype(np.int64) % DIMS
    both, count = np.unique(np.concatenate(who) * DIMS + place, return_counts=True)
    word, value = both // DIMS, count.astype(np.float64)
    length = np.sqrt(np.bincount(word, value * value, minlength=len(ws)))
    return word, both % DIMS, value / length[word]


def vector(text: str) -> np.ndarray:
    x = np.zeros(DIMS, np.float32)
    ws = words(text)
    _, place, value = letters(ws)
    np.add.at(x, place, value)
    return x / max(1, len(ws))


def machine(x: np.ndarray, y: np.ndarray, cost: float = 20.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """A linear support vector machine by dual coordinate ascent: weights and offset; y is +1 or -1."""
    gram = (x @ x.T).astype(np.float64) + 0.01
    alpha, out = np.zeros(len(x)), np.zeros(len(x))
    rng = np.random.default_rng(3)
    for _ in range(rounds):
        largest = 0.0
        for i in rng.permutation(len(x)):
            new = min(cost, max(0.0, alpha[i] + (1 - y[i] * out[i]) / gram[i, i]))
            step = new - alpha[i]
            if step:
                out += step * y[i] * gram[i]
                alpha[i] = new
                largest = max(largest, abs(step))
        if largest < 1e-3:
            break
    return (alpha * y).astype(np.float32) @ x, 0.01 * float((alpha * y).sum())


@dataclass
class Model:
    """Binary machines as rows of `weights`: for each pair (a, b), positive says a. Pairs are of families and of languages."""

    pairs: list[tuple[str, str]]
    weights: np.ndarray
    offsets: np.ndarray
    slope: float = SLOPE
    place: dict[str, int] = field(default_factory=dict)
    known: np.ndarray | None = None

    def rows_of(self, tokens: list[str]) -> np.ndarray:
        """Summed margins (without offsets) of each token's words, and in the last column their number."""
        if len(self.place) > 1 << 19:
            self.place, self.known = {}, None  # what a task has seen is forgotten when it becomes too much
        new = [t for t in dict.fromkeys(tokens) if t not in self.place]
        if new:
            lists = [token_words(t) for t in new]
            sizes = np.array([len(x) for x in lists])
            different = list(dict.fromkeys(chain.from_iterable(lists)))
            number = {w: n for n, w in enumerate(different)}
            of_word = np.zeros((len(different), len(self.pairs)), np.float32)
            for lo in range(0, len(different), 8_192):
                word, at, value = letters(different[lo : lo + 8_192])
                start = np.flatnonzero(np.diff(word, prepend=-1))
                of_word[lo : lo + 8_192] = np.add.reduceat(self.weights.T[at] * value[:, None].astype(np.float32), start)
            rows = np.zeros((len(new), len(self.pairs) + 1), np.float32)
            rows[:, -1] = sizes
            flat = np.array([number[w] for x in lists for w in x], np.int64)
            some = np.flatnonzero(sizes)
            if len(some):
                rows[some, :-1] = np.add.reduceat(of_word[flat], (np.cumsum(sizes) - sizes)[some])
            base = 0 if self.known is None else len(self.place)
            if self.known is None or base + len(new) > len(self.known):
                grown = np.zeros((max(4_096, 2 * (base + len(new))), len(self.pairs) + 1), np.float32)
                if base:
                    grown[:base] = self.known[:base]
                self.known = grown
            self.known[base : base + len(new)] = rows
            self.place.update({t: base + n for n, t in enumerate(new)})
        if self.known is None:
            return np.zeros((0, len(self.pairs) + 1), np.float32)
        return self.known[[self.place[t] for t in tokens]]

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language, confidence, family margin, language margin) of each row of margins: the family by votes, then the language
        within it by votes; languages are places in `LANGUAGES`."""

        def vote(names: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
            won = np.zeros((len(margins), len(names)))
            least = np.full((len(margins), len(names)), np.inf)
            for n, (a, b) in enumerate(self.pairs):
                if a in names and b in names:
                    m, i, j = margins[:, n], names.index(a), names.index(b)
                    won[:, i] += m > 0
                    won[:, j] += m <= 0
                    least[:, i] = np.minimum(least[:, i], m)
                    least[:, j] = np.minimum(least[:, j], -m)
            # by victories, then by the least margin
            best = (won + np.tanh(np.where(np.isinf(least), 0, least)) * 0.4).argmax(1)
            return best, least[np.arange(len(best)), best]

        family, clear = vote(tuple(FAMILIES))
        language, apart = np.zeros(len(margins), int), np.full(len(margins), np.inf)
        for f, names in enumerate(FAMILIES.values()):
            at = family == f
            if at.any():
                within, margin = vote(names)
                language[at] = np.array([LANGUAGES.index(n) for n in names])[within[at]]
                apart[at] = margin[at]
        return language, _logistic(self.slope * clear) * _logistic(self.slope * apart), clear, apart


#: All languages, in the order of their families.
LANGUAGES = tuple(c for cs in FAMILIES.values() for c in cs)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def fit(rows: list[tuple[str, str]]) -> Model:
    """Machines from (language, sentence) rows; each sentence also counts without its accents."""
    family_of = {c: f for f, cs in FAMILIES.items() for c in cs}
    rows = [(c, t) for c, t in rows if c in family_of and t]
    both = rows + [(c, plain(t)) for c, t in rows if plain(t) != t]
    x = np.array([vector(t) for _, t in both])
    label = [c for c, _ in both]
    family = [family_of[c] for c in label]
    pairs, weights, offsets = [], [], []
    for names, of in [(tuple(FAMILIES), family), *((cs, label) for cs in FAMILIES.values())]:
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                at = [k for k, c in enumerate(of) if c in (a, b)]
                w, o = machine(x[at], np.array([1.0 if of[k] == a else -1.0 for k in at]))
                pairs.append((a, b))
                weights.append(w)
                offsets.append(o)
    return Model(pairs, np.array(weights, np.float32), np.array(offsets, np.float32))


@dataclass
class Found:
    """Sentences with words of several texts: text number, range in it, summed margins, number of words."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    sums: np.ndarray
    n: np.ndarray


def scored(texts: list[str], model: Model) -> Found:
    clean = [t.replace("\x00", " ") for t in texts]
    joined = _cleared("\x00".join(clean))
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in clean])])
    start, end = _ranges(joined)
    lists = [joined[a:b].split() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    size = np.array([len(x) for x in lists])
    some = np.flatnonzero(size)
    rows = model.rows_of(list(chain.from_iterable(lists)))
    sums = np.add.reduceat(rows, (np.cumsum(size) - size)[some]) if len(some) else np.zeros((0, len(model.pairs) + 1), np.float32)
    said = sums[:, -1] > 0
    at = some[said]
    text = np.searchsorted(first, start[at], "right") - 1
    return Found(text, start[at] - first[text], end[at] - first[text], sums[said, :-1], sums[said, -1].astype(np.int64))


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for n, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield lo, n
            lo, size = n, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def stretches(texts: list[str], model: Model, least: float = 0.6, most_words: int = 3) -> tuple[np.ndarray, ...]:
    """(text number, place from 1, language, confidence, start, end) of each stretch of texts, as arrays.

    A sentence of fewer than `most_words` words, or with margins that say less than `least` before calibration, takes the language of the
    stretch before it, or of the one after it where there is none. A text without any other is decided as a whole if it has
    two words; one without words has no stretch.
    """
    f = scored(texts, model)
    if not len(f.text):
        return tuple(np.empty(0, t) for t in (int, int, int, float, int, int))
    language, sure, clear, apart = model.decide(f.sums / f.n[:, None] + model.offsets)
    firm = (f.n >= most_words) & (_logistic(SLOPE * clear) * _logistic(SLOPE * apart) >= least)
    head = np.flatnonzero(np.diff(f.text, prepend=-1))
    count = np.diff(np.append(head, len(f.text)))
    any_firm = np.logical_or.reduceat(firm, head)
    low = np.minimum.reduceat(np.where(firm, language, len(LANGUAGES)), head)
    high = np.maximum.reduceat(np.where(firm, language, -1), head)
    total, words_in = np.add.reduceat(f.sums, head), np.add.reduceat(f.n, head)
    weight = np.add.reduceat(np.where(firm, sure * f.n, 0.0), head) / np.maximum(1, np.add.reduceat(np.where(firm, f.n, 0), head))
    whole_language, whole_sure, _, _ = model.decide(total / words_in[:, None] + model.offsets)
    one = np.where(any_firm, low == high, words_in >= 2)
    out = [np.stack([f.text[head], np.ones(len(head), int), np.where(any_firm, low, whole_language), f.start[head], f.end[head + count - 1]])[:, one]]
    surety = [np.where(any_firm, weight, whole_sure)[one]]
    for d in np.flatnonzero(any_firm & (low != high)).tolist():
        rows = range(head[d], head[d] + count[d])
        last = next(language[i] for i in rows if firm[i])
        parts: list[list] = []
        for i in rows:
            last = language[i] if firm[i] else last
            if not parts or parts[-1][0] != last:
                parts.append([last, f.start[i], f.end[i], 0.0, 0])
            parts[-1][2] = f.end[i]
            parts[-1][3] += sure[i] * f.n[i] * firm[i]
            parts[-1][4] += f.n[i] * firm[i]
        out.append(np.array([[f.text[head[d]], n, p[0], p[1], p[2]] for n, p in enumerate(parts, 1)]).T)
        surety.append(np.array([p[3] / max(1, p[4]) for p in parts]))
    every, p = np.concatenate(out, axis=1), np.concatenate(surety)
    order = np.lexsort((every[1], every[0]))
    text, place, lang, start, end = every[:, order]
    return text, place, lang, p[order], start, end


def agreeing(model: Model, docs: list[tuple[str, str]], rows: int) -> list[tuple[str, str]]:
    """Up to `rows` different sentences, as many of each language, of the documents whose label is the language of the whole."""
    most = rows // len(LANGUAGES)
    kept: dict[str, dict[str, str]] = {c: {} for c in LANGUAGES}
    f = scored([t for _, t in docs], model)
    if not len(f.text):
        return []
    language, _, _, _ = model.decide(f.sums / f.n[:, None] + model.offsets)
    head = np.flatnonzero(np.diff(f.text, prepend=-1))
    count = np.diff(np.append(head, len(f.text)))
    whole, _, _, _ = model.decide(np.add.reduceat(f.sums, head) / np.add.reduceat(f.n, head)[:, None] + model.offsets)
    for d, h, n in zip(whole.tolist(), head.tolist(), count.tolist(), strict=True):
        label, text = docs[f.text[h]]
        if label in kept and LANGUAGES[d] == label:
            for i in range(h, h + n):
                if f.n[i] >= 3 and len(kept[label]) < most and (LANGUAGES[language[i]] == label or n == 1):
                    p = text[f.start[i] : f.end[i]]
                    kept[label].setdefault(" ".join(words(p)), p)
    return [(c, p) for c, ps in kept.items() for p in ps.values()]


def calibrated(model: Model, docs: list[tuple[str, str]]) -> float:
    """The slope of the logistic curve that makes the labels of held-out documents likeliest, sentence by sentence.

    Labels may be wrong: with a share of wrong ones e, a label agrees with a decision of probability p by p (1 - e) + e / 8.
    The pair of slope and share that explains the agreement best is sought on a grid. With fewer than `HELD` sentences the slope
    stays as it is.
    """
    f = scored([t for _, t in docs], model)
    if (f.n >= 3).sum() < HELD:
        return model.slope
    language, _, clear, apart = model.decide(f.sums / f.n[:, None] + model.offsets)
    use = f.n >= 3
    right = np.array([LANGUAGES[a] == docs[t][0] for a, t in zip(language.tolist(), f.text.tolist(), strict=True)])[use]
    best, slope = -np.inf, model.slope
    for s in 2.0 ** np.arange(-2, 6.5, 0.5):
        p = _logistic(s * clear[use]) * _logistic(s * apart[use])
        for e in (0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3):
            q = np.clip(p * (1 - e) + e / len(LANGUAGES), 1e-9, 1 - 1e-9)
            value = np.log(np.where(right, q, 1 - q)).sum()
            if value > best:
                best, slope = value, float(s)
    return slope


def _classify(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    names = pa.array(LANGUAGES)
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for lo, hi in _chunks(texts):
            text, place, lang, sure, start, end = stretches(texts[lo:hi], model)
            number = np.bincount(text, minlength=hi - lo)[text] if len(text) else text
            at = pa.array(text + lo)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(place, pa.int32()), pa.array(number, pa.int32()), names.take(pa.array(lang)), pa.array(sure, pa.float64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), batch.column(2).take(at)],
                ["doc_id", "segment_no", "segments", "lang_code", "confidence", "start", "end", "label"],
            )


def classify(docs: DataFrame, samples: DataFrame, rows: int = ROWS, documents: int = DOCS) -> DataFrame:
    """(doc_id, segment_no, segments, lang_code, confidence, start, end, label): one row per stretch of each document.

    docs: (doc_id, text, lang). samples: (lang_code, text). label is the document's own label as a code (see `code`), null if
    it says nothing. Documents that are null, empty or all code have no row; rows without doc_id take no part; repeated rows
    are classified again. Samples that are null are left out; without samples there is nothing to decide by: an error.
    """
    labelled = samples.where(F.col("text").isNotNull()).select(code(F.col("lang_code")).alias("c"), "text").where(F.col("c").isNotNull())
    drawn = [(r["c"], r["text"]) for r in labelled.orderBy(F.xxhash64("text"), "text").limit(rows).collect()]
    if not drawn:
        raise ValueError("no labelled sentences to fit on")
    model = fit(drawn)
    ours = docs.where((F.length("text") <= DOC_CHARS) & F.col("doc_id").isNotNull()).select("text", code(F.col("lang")).alias("c")).where(F.col("c").isin(*NOTATIONS))
    # the first by hash: each task keeps at most that many
    more = [(r["c"], r["text"]) for r in ours.orderBy(F.xxhash64("text"), "text").limit(documents).collect()]
    model = fit(drawn + agreeing(model, [d for n, d in enumerate(more) if n % 4], rows))
    model.slope = calibrated(model, more[::4])
    picked = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", code(F.col("lang")).alias("label"))
    return spread(picked).mapInArrow(lambda it: _classify(it, model), "doc_id long, segment_no int, segments int, lang_code string, confidence double, start long, end long, label string")


def mislabelled(found: DataFrame) -> DataFrame:
    """The stretches of documents whose label is missing or wrong, or that hold more than one language."""
    return found.where((F.col("segments") > 1) | F.col("label").isNull() | (F.col("label") != F.col("lang_code")))
