"""Missing or wrong language labels: script ranges, per-word scores and a Viterbi pass over a text's sentences.

The word model (naive Bayes over character n-grams and words) is trained here, on the labelled rows of the corpus itself.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The languages and other spellings of their labels, in lower case (ISO 639-1, 639-2/T, 639-2/B, English, own name).
LABELS = {
    "en": ["en", "eng", "english"],
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano"],
    "pt": ["pt", "por", "portuguese", "português", "portugues"],
    "nl": ["nl", "nld", "dut", "dutch", "nederlands"],
    "it": ["it", "ita", "italian", "italiano"],
    "sv": ["sv", "swe", "swedish", "svenska"],
    "da": ["da", "dan", "danish", "dansk"],
    "ru": ["ru", "rus", "russian", "русский"],
    "pl": ["pl", "pol", "polish", "polski"],
    "ja": ["ja", "jpn", "japanese", "日本語"],
}
LANGUAGES = list(LABELS)
#: Languages that only their script or letters tell, and `und` for what stays open.
BY_SCRIPT = ["uk", "el", "ko", "he", "th", "hy", "ka", "und"]
STATES = LANGUAGES + BY_SCRIPT
_AT = {x: i for i, x in enumerate(STATES)}
#: Unicode ranges of scripts, and the states each leaves open; letters of no range here are Latin.
SCRIPTS = [
    ("cyrillic", "\u0400-\u052f", ["ru", "uk", "und"]), ("kana", "\u3040-\u30ff\u31f0-\u31ff\uff66-\uff9f", ["ja"]), ("han", "\u2e80-\u2fdf\u3005\u3007\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff", ["ja", "und"]),
    ("hangul", "\u1100-\u11ff\u3130-\u318f\uac00-\ud7af", ["ko"]), ("greek", "\u0370-\u03ff\u1f00-\u1fff", ["el"]), ("hebrew", "\u0590-\u05ff", ["he"]), ("thai", "\u0e00-\u0e7f", ["th"]),
    ("armenian", "\u0530-\u058f", ["hy"]), ("georgian", "\u10a0-\u10ff\u1c90-\u1cbf", ["ka"]), ("other", "\u0600-\u06ff\u0700-\u07ff\u0840-\u08ff\u0900-\u0dff\u0e80-\u109f\u1200-\u137f\u1780-\u18af\ua000-\ua4cf\ufb50-\ufdff\ufe70-\ufeff", ["und"]),
]
LATIN = [x for x in LANGUAGES if x not in ("ru", "ja")]
#: Labelled rows per language that the word model is fitted on at most (a documented bound; chosen by hash of the text), and the bytes of the longest of them.
FIT_ROWS, FIT_BYTES = 500, 40_000
#: Cost of a change of language between two sentences, in the units of word scores.
SWITCH = 6.0
#: Weight of a word's n-gram evidence; the n-grams of a word overlap, so the full sum would be overconfident.
SCALE = 0.25
#: Scores of a state that a word's script rules out, the lowest of one it leaves open, and of the state `und` beside a language.
RULED_OUT, LEAST, OPEN = -12.0, -8.0, -3.0
#: Confidence below which a segment's language is `und`.
UNSURE = 0.2
MAX_N = 4

_JA = "\u3040-\u30ff\u31f0-\u31ff\uff66-\uff9f\u2e80-\u2fdf\u3005\u3007\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_WORD = re.compile(rf"[{_JA}]+|[^\W\d_{_JA}]+(?:['’][^\W\d_{_JA}]+)?")
_SCRIPT = [(re.compile(f"[{r}]"), may) for _, r, may in SCRIPTS]
_HAN_ONLY = re.compile(f"[{SCRIPTS[2][1]}]+")
_NOT_RUSSIAN = re.compile(r"[іїєґўјљњћђџѓќѕ]")
_UKRAINIAN, _RUSSIAN = re.compile(r"[їєґ]|^[іІ]$|і"), re.compile(r"[ыэъё]")
_QUOTED = re.compile(r"[(\[]?\s*[“„«\"‚‘][^“”„«»\"\n]{1,60}[”“»«\"’]\s*[)\]]?")
_QUOTE = re.compile(r"[“„«\"‚‘]")
#: Tried at the start of a run of signs or letters only, or each would be tried at every letter.
_CODE = re.compile(r"\{[^{}\n]*\}|(?<![!-~])(?:[!-~]*[/_\\=<>][!-~]*|[!-~]+@[!-~]+)|(?<![A-Za-z0-9])[A-Za-z]*[0-9][A-Za-z0-9]*|[/_\\=<>][!-~]*")
_CODE_SIGN = re.compile(r"[0-9{@/_\\=<>]")
#: Where a sentence may end: at a stop with closing signs and space after it, at a CJK stop, at a line's end, at a dash or bar between spaces.
_END = re.compile(r"[.!?…][\"”»“’)\]]*\s+|[。！？]\s*|[\r\n]+|[—–/|·]+\s+")


def label_language(label: Column) -> Column:
    """The ISO 639-1 code of a delivered label; null where it is missing or names none of the languages.

    Case, outer spaces and a region or script after - or _ don't count.
    """
    plain = F.lower(F.regexp_replace(label, r"^[\s\u00a0]+|[\s\u00a0]+$", ""))
    codes = F.create_map(*[F.lit(x) for code, words in LABELS.items() for word in words for x in (word, code)])
    return F.try_element_at(codes, F.regexp_extract(plain, r"^([^-_]+)", 1))


def plain_letters(word: str) -> str:
    """Without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def split_sentences(text: str) -> list[str]:
    """The text cut after each end of a sentence (see _END)."""
    out, start = [], 0
    for m in _END.finditer(text):
        if text[m.start()] in "—–/|·" and not (m.start() > start and text[m.start() - 1].isspace()):
            continue
        out.append(text[start : m.end()])
        start = m.end()
    out.append(text[start:])
    return out


def _words(part: str) -> list[str]:
    words = _WORD.findall(_CODE.sub(" ", part) if _CODE_SIGN.search(part) else part)
    # codes such as LDL or TSH in a line that isn't in capitals throughout
    if any(not w.isupper() for w in words):
        return [w.lower() for w in words if not (2 <= len(w) <= 4 and w.isascii() and w.isupper())]
    if len(words) <= 3 and all(len(w) <= 4 and w.isascii() for w in words):
        return []
    return [w.lower() for w in words]


def sentences_of(text: str) -> list[list[str]]:
    """The words of each sentence in lower case; figures, codes, quotes and emoji are no words. Sentences without words stay, empty."""
    text = unicodedata.normalize("NFKC", text.replace(" ", " ").replace("’", "'"))
    bare = _QUOTED.sub(" ", text) if _QUOTE.search(text) else text
    parts = split_sentences(bare)
    out = [_words(p) for p in parts]
    if bare is not text and not any(out) and not any(_WORD.search(_CODE.sub(" ", p)) for p in parts):
        out = [_words(p) for p in split_sentences(text)]  # nothing but a quote
    return out


def grams(word: str) -> list[str]:
    padded = f" {word} "
    out = [padded[i : i + n] for n in range(1, MAX_N + 1) for i in range(len(padded) - n + 1)]
    out.append(f"#{word}")
    out.append(f"#{word}")
    return [g for g in out if g != " "]


def open_states(word: str) -> list[str]:
    """The states that the word's script leaves open."""
    if word.isascii():
        return LATIN
    for script, may in _SCRIPT:
        if script.search(word):
            return may
    return LATIN


class WordModel:
    """Per-word scores of the states, from n-gram log-likelihoods of the languages and from scripts."""

    def __init__(self, grams_: dict[str, int], counts: np.ndarray):
        """counts: a row for each n-gram, a column for each of LANGUAGES."""
        self.at = grams_
        total = counts.sum(axis=0) if len(counts) else np.zeros(len(LANGUAGES))
        self.table = np.log((counts + 0.2) / (total + 0.2 * max(len(counts), 1))).astype(np.float32)
        self.cache: dict[str, int] = {}
        self.scores = np.zeros((0, len(STATES)))
        self.latin = np.array([x in LATIN for x in LANGUAGES])

    def _new(self, words: list[str]) -> np.ndarray:
        out = np.full((len(words), len(STATES)), RULED_OUT)
        told, found, ends = [], [], [0]
        for i, w in enumerate(words):
            may = open_states(w)
            if may is LATIN:
                told.append(i)
                found.extend(x for x in map(self.at.get, grams(w)) if x is not None)
                ends.append(len(found))
            elif may[0] == "ru":
                uk, ru = bool(_UKRAINIAN.search(w)), bool(_RUSSIAN.search(w))
                foreign = bool(_NOT_RUSSIAN.search(w))
                out[i, _AT["ru"]] = LEAST if foreign else 0.0
                out[i, _AT["uk"]] = 0.0 if uk and not ru else LEAST if ru or foreign else -0.7
                out[i, _AT["und"]] = 0.0 if foreign and not uk else OPEN
            elif may[0] == "ja" and len(may) > 1 and _HAN_ONLY.fullmatch(w):
                # Han without kana: Japanese as far as its characters and their pairs were met in Japanese
                pairs = [w[k : k + 2] for k in range(len(w) - 1)] or [w]
                met = sum(g in self.at and self.table[self.at[g], _AT["ja"]] >= self.table[self.at[g]].max() for g in pairs) / len(pairs)
                out[i, _AT["ja"]], out[i, _AT["und"]] = -3.0 * (1 - met), -3.0 * met
            else:
                out[i, _AT["ja" if may[0] == "ja" else may[0]]] = 0.0
        if told:
            sums = np.zeros((len(told), len(LANGUAGES)))
            if found:
                total = np.concatenate([np.zeros((1, len(LANGUAGES))), np.cumsum(self.table[found].astype(float), axis=0)])
                sums = total[ends[1:]] - total[ends[:-1]]
            sums = SCALE * (sums - sums[:, self.latin].max(axis=1, keepdims=True))
            out[np.array(told)[:, None], np.arange(len(LANGUAGES))] = np.where(self.latin, np.maximum(sums, LEAST), RULED_OUT)
            out[told, _AT["und"]] = LEAST
        return out

    def of(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word, each distinct word scored once. The cache is bounded: it is emptied at 200,000 words."""
        if len(self.cache) > 200_000:
            self.cache, self.scores = {}, np.zeros((0, len(STATES)))
        new = [w for w in dict.fromkeys(words) if w not in self.cache]
        if new:
            self.cache.update(zip(new, range(len(self.scores), len(self.scores) + len(new))))
            self.scores = np.concatenate([self.scores, self._new(new)])
        return self.scores[list(map(self.cache.__getitem__, words))]


class _Trainer:
    """Word and n-gram tables of the fitting rows, built once for all rounds."""

    def __init__(self, words: list[str]):
        self.word = {w: i for i, w in enumerate(words)}
        self.gram: dict[str, int] = {}
        of, which = [], []
        for i, w in enumerate(words):
            for g in grams(w):
                of.append(i)
                which.append(self.gram.setdefault(g, len(self.gram)))
        self.of, self.which = np.array(of, int), np.array(which, int)

    def model(self, counts: Counter) -> WordModel:
        """counts by (language, word). Rare n-grams are left out."""
        n = np.zeros((len(self.word), len(LANGUAGES)))
        for (lang, w), x in counts.items():
            n[self.word[w], lang] += x
        table = np.stack([np.bincount(self.which, n[self.of, k], len(self.gram)) for k in range(len(LANGUAGES))], axis=1) if len(self.gram) else np.zeros((0, len(LANGUAGES)))
        keep = table.sum(axis=1) >= 1.0
        names = [g for g, k in zip(self.gram, keep) if k]
        return WordModel({g: i for i, g in enumerate(names)}, table[keep])


def _count(sentences: list[tuple[int, list[str]]]) -> Counter:
    """Words by language; each counts with and, at a third, without its accents."""
    words: Counter = Counter((lang, w) for lang, ws in sentences for w in ws)
    for (lang, w), n in list(words.items()):
        bare = w if w.isascii() else plain_letters(w)
        if bare != w:
            words[lang, bare] += 0.34 * n
    return words


def fit(rows: list[tuple[str, str]], rounds: int = 3) -> WordModel:
    """rows: (language, text), labels partly wrong. Each further round takes only sentences whose language the model of the
    round before clearly gives, under that language: wrong labels and foreign sentences drop out."""
    index = {x: i for i, x in enumerate(LANGUAGES)}
    sentences = [(index[lang], ws) for lang, text in rows if lang in index and text for ws in sentences_of(text) if ws]
    counts = _count(sentences)
    trainer = _Trainer(list(dict.fromkeys(w for _, w in counts)))
    model = trainer.model(counts)
    if not sentences:
        return model
    flat = [w for _, ws in sentences for w in ws]
    starts = np.cumsum([0] + [len(ws) for _, ws in sentences])[:-1]
    for _ in range(rounds - 1):
        scores = np.add.reduceat(model.of(flat), starts)[:, : len(LANGUAGES)]
        best, margin = scores.argmax(axis=1), -np.diff(np.partition(scores, -2)[:, -2:])[:, 0]
        clean = [(int(b), ws) for (lang, ws), b, m in zip(sentences, best, margin) if b == lang or -m > 3.0]
        if not clean:
            break
        model = trainer.model(_count(clean))
    return model


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> list[int]:
    """The best state of each sentence, where a change costs `switch`. Words share their sentence's state."""
    n, k = scores.shape
    best, back = scores[0].copy(), np.zeros((n, k), int)
    for i in range(1, n):
        top = int(best.argmax())
        stay = best >= best[top] - switch
        back[i] = np.where(stay, np.arange(k), top)
        best = np.where(stay, best, best[top] - switch) + scores[i]
    path = [int(best.argmax())]
    for i in range(n - 1, 0, -1):
        path.append(int(back[i][path[-1]]))
    return path[::-1]


def segments_of_all(texts: list[str | None], model: WordModel) -> list[list[tuple[int, str, float, int]]]:
    """For each text (seg_no, lang, confidence, words) of its segments: maximal runs of sentences in one language. Nothing without words.

    confidence: the posterior of the segment's language from its word scores; below UNSURE the language is `und`.
    """
    found = [[ws for ws in sentences_of(t) if ws] if t else [] for t in texts]
    flat = [w for f in found for ws in f for w in ws]
    if not flat:
        return [[] for _ in texts]
    sizes = np.array([len(ws) for f in found for ws in f])
    sums = np.add.reduceat(model.of(flat), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    lengths = np.array([len(f) for f in found])
    full = np.flatnonzero(lengths)
    first = np.cumsum(lengths)[full] - lengths[full]
    best = sums.argmax(axis=1)
    # where every sentence has the same best state, so has the best path
    even = np.minimum.reduceat(best, first) == np.maximum.reduceat(best, first)
    whole, words = np.add.reduceat(sums, first), np.add.reduceat(sizes, first)
    sure = 1 / np.exp(np.minimum(whole - whole[np.arange(len(first)), best[first]][:, None], 0)).sum(axis=1)  # used where even
    out: list[list[tuple[int, str, float, int]]] = [[] for _ in texts]
    for i, state, p, n in zip(full[even].tolist(), best[first[even]].tolist(), sure[even].tolist(), words[even].tolist()):
        out[i] = [(1, STATES[state] if p >= UNSURE else "und", p, n)]
    for i, a in zip(full[~even].tolist(), first[~even].tolist()):
        scores, n = sums[a : a + lengths[i]], sizes[a : a + lengths[i]]
        path = np.array(viterbi(scores))
        edges = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
        rows = out[i]
        for state, s, k in zip(path[edges], np.add.reduceat(scores, edges), np.add.reduceat(n, edges)):
            p = np.exp(s - s.max())
            one = float(p[state] / p.sum())
            name = STATES[state] if one >= UNSURE else "und"
            if rows and rows[-1][1] == name:
                rows[-1] = (rows[-1][0], name, max(rows[-1][2], one), rows[-1][3] + int(k))
            else:
                rows.append((len(rows) + 1, name, one, int(k)))
    return out


def segments_of(text: str | None, model: WordModel) -> list[tuple[int, str, float, int]]:
    """See segments_of_all."""
    return segments_of_all([text], model)[0]


def fit_on(texts: DataFrame, text: str, label: str, per_language: int = FIT_ROWS, longest: int = FIT_BYTES) -> WordModel:
    """Fits the word model on at most about `per_language` labelled rows of each language, picked by a hash of the text, of at most
    `longest` bytes.

    This sample is the only thing gathered on the driver, and its size doesn't grow with the corpus; everything else covers
    all rows.
    """
    known = texts.select(label_language(F.col(label)).alias("lang"), F.col(text).alias("text"), F.octet_length(text).alias("bytes")).filter(f"lang is not null and bytes between 1 and {longest}")
    n = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return fit([])
    share = F.try_element_at(F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, min(1.0, per_language / v))]), F.col("lang"))
    picked = known.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20))
    return fit([(r["lang"], r["text"]) for r in picked.select("lang", "text").limit(2 * per_language * len(n)).collect()])


def label_segments(texts: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", model: WordModel | None = None) -> DataFrame:
    """(key, seg_no, lang, confidence, words, n_segments, label_lang): a row per segment of each text.

    Null, empty and wordless texts give no rows; every row of the input is taken by itself, so repeated rows repeat their
    segments. label_lang is what the label names, null where missing or unknown. lang is one of the languages of the model, one
    that its script tells (BY_SCRIPT), or `und`. Other columns are ignored. A text is
    worked on whole. Without `model` one is fitted on the labelled rows of `texts`.
    """
    model = model or fit_on(texts, text, label)
    shared = texts.sparkSession.sparkContext.broadcast((model.at, model.table))
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = WordModel({}, np.zeros((0, len(LANGUAGES))))
        mine.at, mine.table = shared.value
        for part in batches:
            found = segments_of_all(part["text"].to_pylist(), mine)
            of = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            rows = [x for f in found for x in f]
            columns = list(zip(*rows)) if rows else [(), (), (), ()]
            n = pa.array([len(f) for f in found], pa.int32()).take(of)
            yield pa.RecordBatch.from_arrays([part["key"].take(of), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int32()), n, part["named"].take(of)], names=["key", "seg_no", "lang", "confidence", "words", "n_segments", "label_lang"])

    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text"), label_language(F.col(label)).alias("named"))
    out = rows.mapInArrow(run, f"key {kind}, seg_no int, lang string, confidence double, words int, n_segments int, label_lang string")
    return out.withColumnRenamed("key", key)
