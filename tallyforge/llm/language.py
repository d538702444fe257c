"""Language of a text from per-language piece probabilities, summed over all segmentations.

The pieces are the letter pieces of a fixed public vocabulary (a sentencepiece model). A run of letters, lower-cased
and marked at its start, has under a language the probability of all ways to cut it into pieces, which
a forward pass adds up; a text's likelihood is the product over its runs. The piece probabilities of a
language are fitted by expectation maximisation on labelled texts: forward and backward passes give the expected uses
of each piece, in tasks over distinct words, and one row for each language and piece comes back.

Runs of one length pass together as matrices. Runs of over `LONGEST` letters pass letter by letter and carry the forward
state of the last letters, scaled as they go, so a run of any length is summed whole and in little memory. Letters outside
the vocabulary cost a fixed probability each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import HashTable, work_folder, written
from tallyforge.llm.pieces import Memo, slices

MARK = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
LONGEST = 32
CELLS = 2_000_000  # letters of long runs that pass together
UNKNOWN = 1e-6
FAR = 6.0  # standard deviations that a text's mean log likelihood a letter may lie below its language's
LEAST_SPREAD = 0.1  # of that likelihood among the texts of one language, however alike the labelled ones are
LIFT = 20.0  # each letter's probability is scaled by this, so that products stay in range
ROWS = 20_000
MULTIPLIER = np.uint64(0x5851F42D4C957F2D)


@lru_cache(maxsize=2)
def letter_pieces(path: str) -> list[str]:
    """Distinct lower-case pieces that hold letters only, but for a leading mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in found if p == MARK or LETTERS.fullmatch(p.removeprefix(MARK)))


def _runs(word: str) -> list[str]:
    """Letter runs, each with a mark before it."""
    return [MARK + run for run in LETTERS.findall(word)]


def _matrix(runs: list[str], size: int) -> np.ndarray:
    return np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32).reshape(-1, size).astype(np.uint64)


def _by_size(runs: list[str], most: float = np.inf) -> Iterator[tuple[int, np.ndarray]]:
    """Length and positions of runs of one length up to `most`, some rows at a time."""
    sizes = np.fromiter(map(len, runs), np.int64, len(runs))
    for size in np.unique(sizes[sizes <= most]):
        at = np.flatnonzero(sizes == size)
        for i in range(0, len(at), ROWS):
            yield int(size), at[i:i + ROWS]


def _long(runs: list[str]) -> list[int]:
    """Positions of the runs of over LONGEST letters, the shortest first."""
    return sorted((i for i, run in enumerate(runs) if len(run) > LONGEST + 1), key=lambda i: len(runs[i]))


def _hashes(pieces: list[str]) -> np.ndarray:
    out = np.zeros(len(pieces), np.uint64)
    for size, at in _by_size(pieces):
        codes = _matrix([pieces[i] for i in at], size)
        value = np.zeros(len(at), np.uint64)
        for column in range(size):
            value = (value + codes[:, column]) * MULTIPLIER
        out[at] = value
    return out


@dataclass
class Model:
    """Languages, the table from piece hashes to rows, and probabilities: a row a piece, the last for unknown letters."""

    languages: list[str]
    table: HashTable
    probabilities: np.ndarray  # [pieces + 1, languages], already lifted by LIFT ** length
    usual: np.ndarray | None = None  # [languages, 3]: log likelihood a letter, its variance among texts, and that of a single letter
    span: int = 16  # the length of the longest piece

    def spans(self, codes: np.ndarray) -> list[list[np.ndarray]]:
        """[start][length - 1] -> row of the piece that covers those letters, or -1."""
        size, unknown = codes.shape[1], len(self.probabilities) - 1
        out = []
        for start in range(size):
            value, row = np.zeros(len(codes), np.uint64), []
            for end in range(start, min(size, start + self.span)):
                value = (value + codes[:, end]) * MULTIPLIER
                row.append(self.table.get(value))
            row[0] = np.where(row[0] < 0, unknown, row[0])
            out.append(row)
        return out

    def forward(self, spans: list[list[np.ndarray]], rows: int) -> list[np.ndarray]:
        """Lifted probability of each prefix under each language."""
        padded = np.vstack([self.probabilities, np.zeros(self.probabilities.shape[1])])  # row -1: no such piece
        before = [np.ones((rows, self.probabilities.shape[1]))]
        for end in range(1, len(spans) + 1):
            total = np.zeros_like(before[0])
            for start in range(max(0, end - self.span), end):
                ids = spans[start][end - start - 1]
                hit = np.flatnonzero(ids >= 0)
                if len(hit) * 2 < rows:
                    total[hit] += before[start][hit] * padded[ids[hit]]
                else:
                    total += before[start] * padded[ids]
            before.append(total)
        return before

    def long_runs(self, runs: list[str]) -> np.ndarray:
        """Log likelihood of each run under each language, letter by letter over all of them; shorter ones are padded."""
        sizes, kinds = np.array([len(run) for run in runs]), self.probabilities.shape[1]
        codes = np.zeros((len(runs), sizes.max()), np.uint64)
        for row, run in enumerate(runs):
            codes[row, :len(run)] = _matrix([run], len(run))[0]
        padded, unknown = np.vstack([self.probabilities, np.zeros(kinds)]), len(self.probabilities) - 1
        hashes = np.zeros((self.span, len(runs)), np.uint64)  # [length - 1]: of the piece that ends here
        recent = np.zeros((self.span, len(runs), kinds))  # [n]: probability of the prefix n letters back, over that of the last one
        recent[0] = 1.0
        logs, out = np.zeros((len(runs), kinds)), np.zeros((len(runs), kinds))
        for end in range(1, codes.shape[1] + 1):
            hashes[1:] = hashes[:-1]
            hashes[0] = 0
            hashes = (hashes + codes[:, end - 1]) * MULTIPLIER
            ids = self.table.get(hashes.ravel()).reshape(hashes.shape)
            ids[0] = np.where(ids[0] < 0, unknown, ids[0])
            total = (recent * padded[ids]).sum(axis=0)
            logs += np.log(total)
            recent[1:] = recent[:-1] / total
            recent[0] = 1.0
            done = sizes == end
            out[done] = logs[done]
        return out - sizes[:, None] * np.log(LIFT)

    def floor(self, language: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The least log likelihood a letter that a text of so many letters has if it is of the language."""
        if self.usual is None:
            return np.full(len(language), -np.inf)
        mean, among, single = self.usual[language].T
        return mean - FAR * np.sqrt(np.maximum(among, LEAST_SPREAD ** 2) + single / letters)

    def score(self, words: list[str]) -> np.ndarray:
        """[words, languages + 1]: log likelihood under each language, then the number of letters."""
        out = np.zeros((len(words), len(self.languages) + 1))
        runs = [_runs(word) for word in words]
        owner = np.repeat(np.arange(len(words)), [len(r) for r in runs])
        flat = list(chain.from_iterable(runs))
        for size, at in _by_size(flat, LONGEST + 1):
            codes = _matrix([flat[i] for i in at], size)
            last = self.forward(self.spans(codes), len(at))[-1]
            np.add.at(out, owner[at], np.hstack([np.log(last) - size * np.log(LIFT), np.full((len(at), 1), size - 1.0)]))
        at: list[int] = []
        for i in [*_long(flat), -1]:  # runs of like length together, so that little is padded
            if at and (i < 0 or len(flat[i]) > 2 * len(flat[at[0]]) or len(flat[i]) * (len(at) + 1) > CELLS):
                letters = np.array([[len(flat[j]) - 1.0] for j in at])
                np.add.at(out, owner[at], np.hstack([self.long_runs([flat[j] for j in at]), letters]))
                at = []
            at.append(i)
        return out


def _expected(model: Model, language: int, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in `words` under one language, by forward and backward passes."""
    out = np.zeros(len(model.probabilities))
    own = Model([model.languages[language]], model.table, model.probabilities[:, [language]], span=model.span)
    chance = np.append(own.probabilities[:, 0], 0.0)
    for i in _long(words):
        out += _expected_long(own, words[i], counts[i])
    for size, at in _by_size(words, LONGEST + 1):
        spans = own.spans(_matrix([words[i] for i in at], size))
        before = [b[:, 0] for b in own.forward(spans, len(at))]
        behind = [np.zeros(len(at)) for _ in range(size)] + [np.ones(len(at))]
        for start in range(size - 1, -1, -1):
            for n, ids in enumerate(spans[start], 1):
                behind[start] += chance[ids] * behind[start + n]
        weight = counts[at] / before[-1]
        for start in range(size):
            for n, ids in enumerate(spans[start], 1):
                hit = np.flatnonzero(ids >= 0)
                ids = ids[hit]
                out += np.bincount(ids, before[start][hit] * chance[ids] * behind[start + n][hit] * weight[hit], len(out))
    return out


def _expected_long(model: Model, word: str, count: float) -> np.ndarray:
    """What `_expected` gives for one long run under a model of one language, in logarithms."""
    size, unknown = len(word), len(model.probabilities) - 1
    codes, value = _matrix([word], len(word))[0], np.zeros(len(word), np.uint64)
    ids = np.full((size, model.span), -1, np.int64)  # [start, length - 1]
    for n in range(min(model.span, size)):
        value = (value[:size - n] + codes[n:]) * MULTIPLIER
        ids[:size - n, n] = model.table.get(value)
    ids[ids[:, 0] < 0, 0] = unknown
    with np.errstate(divide="ignore"):
        chance = np.log(np.append(model.probabilities[:, 0], 0.0))[ids]
    before, behind = np.full(size + 1, -np.inf), np.full(size + 1 + model.span, -np.inf)
    before[0] = behind[size] = 0.0
    for end in range(1, size + 1):
        n = np.arange(1, min(model.span, end) + 1)
        before[end] = np.logaddexp.reduce(before[end - n] + chance[end - n, n - 1])
    for start in range(size - 1, -1, -1):
        behind[start] = np.logaddexp.reduce(chance[start] + behind[start + 1:start + 1 + model.span])
    ends = np.arange(size)[:, None] + np.arange(1, model.span + 1)
    share = np.exp(before[:size, None] + chance + behind[ends] - before[size])
    return np.bincount(ids[ids >= 0], share[ids >= 0] * count, len(model.probabilities))


def _probabilities(uses: np.ndarray, pieces: list[str]) -> np.ndarray:
    """Smoothed shares of the pieces of each language, lifted; the last row is an unknown letter's."""
    known = uses[:len(pieces)] + 0.1
    share = known / known.sum(axis=0)
    lifted = share * LIFT ** np.array([len(p) for p in pieces], float)[:, None]
    return np.vstack([lifted, np.full((1, uses.shape[1]), UNKNOWN * LIFT)])


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 1):
        counts: dict[tuple[str, str], int] = {}
        for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            for run in _runs(text.lower()):
                counts[lang, run] = counts.get((lang, run), 0) + 1
        yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in counts], "word": [k[1] for k in counts], "n": list(counts.values())},
                                         schema=pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))


def _text_sums(model: Model, memo: Memo, texts: list[str]) -> np.ndarray:
    """[texts, languages + 1]: what Model.score gives, summed over the words of each text."""
    words = [text.lower().split() for text in texts]
    memo.learn(chain.from_iterable(words))
    return np.vstack([np.frombuffer(b"".join(map(memo.__getitem__, w))).reshape(-1, len(model.languages) + 1).sum(axis=0) for w in words])


def _usual(chosen: DataFrame, model: Model) -> np.ndarray:
    """What the labelled texts show under their own language: Model.usual, from four totals of each language."""
    shared = chosen.sparkSession.sparkContext.broadcast(model)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, at = shared.value, {name: i for i, name in enumerate(shared.value.languages)}
        memo, out = Memo(lambda words: [row.tobytes() for row in model.score(words)]), np.zeros((len(at), 4))
        for part in slices(batches, 1):
            sums = _text_sums(model, memo, part.column(1).to_pylist())
            own, letters = np.array([at[x] for x in part.column(0).to_pylist()]), sums[:, -1]
            likely, n = sums[np.arange(len(own)), own], np.maximum(letters, 1)
            np.add.at(out, own, np.stack([letters > 0, letters, likely, likely * likely / n], axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(at)), pa.int32()), *map(pa.array, out.T)], ["language", "texts", "letters", "likely", "squares"])

    schema = "language int, texts double, letters double, likely double, squares double"
    got = chosen.mapInArrow(totals, schema).groupBy("language").sum("texts", "letters", "likely", "squares").toPandas().to_numpy()
    sums = np.zeros((len(model.languages), 4))
    sums[got[:, 0].astype(int)] = got[:, 1:]
    texts, letters, likely, squares = sums.T
    mean = likely / np.maximum(letters, 1)
    apart = np.maximum(squares - mean * likely, 0)
    usual = np.stack([mean, apart / np.maximum(letters, 1), apart / np.maximum(texts, 1)], axis=1)
    usual[texts == 0] = [-np.inf, 0, 0]  # no text with letters: nothing is known of it
    return usual


def train(labelled: DataFrame, path: str, *, text: str = "text", lang: str = "lang", id_: str = "doc_id",
          sample: int = 2000, rounds: int = 3, max_languages: int = 256) -> Model:
    """Fit the model on labelled rows (rows without label or text are left out).

    The fit uses about `sample` documents of each language, those whose id and text hash lowest, so its cost is
    bounded; the driver gets one number for each language and piece of the fixed vocabulary. Of more than
    `max_languages` different labels, those with the most rows are learned, of equal ones the first by name.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = rows.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(max_languages).collect()
    languages = sorted(r[lang] for r in sizes)
    pieces = letter_pieces(path)
    table = HashTable(_hashes(pieces), np.arange(len(pieces), dtype=np.int32), -1)
    uses = np.ones((len(pieces) + 1, len(languages)))
    if not languages:
        return Model([], table, uses)
    share = F.create_map(*chain.from_iterable((F.lit(r[lang]), F.lit(min(1.0, sample / r["count"]))) for r in sizes))
    draw = F.pmod(F.xxhash64(F.col(id_), F.col(text), F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.where(draw < share[F.col(lang)]).select(lang, text)
    words = chosen.mapInArrow(_distinct_words, "lang string, word string, n long")
    words = written(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), work_folder(spark, "language-words"))
    for _ in range(rounds):
        model = Model(languages, table, _probabilities(uses, pieces), span=max(map(len, pieces)))
        shared = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            at = {name: i for i, name in enumerate(shared.value.languages)}
            for batch in batches:
                langs = np.array([at[x] for x in batch.column(0).to_pylist()])
                texts, counts = batch.column(1).to_pylist(), batch.column(2).to_numpy().astype(float)
                for number in np.unique(langs):
                    mine = np.flatnonzero(langs == number)
                    found = _expected(shared.value, int(number), [texts[i] for i in mine], counts[mine])
                    total[int(number)] = total.get(int(number), 0.0) + found
            for number, found in total.items():
                piece = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(piece), number), pa.int32()), pa.array(piece, pa.int32()),
                                                  pa.array(found[piece], pa.float64())], ["language", "piece", "uses"])

        sums = words.mapInArrow(expect, "language int, piece int, uses double").groupBy("language", "piece").agg(F.sum("uses").alias("uses"))
        uses = np.zeros_like(uses)
        got = sums.toPandas()
        uses[got["piece"], got["language"]] = got["uses"]
    model = Model(languages, table, _probabilities(uses, pieces), span=max(map(len, pieces)))
    model.usual = _usual(chosen, model)
    return model


def predict(docs: DataFrame, model: Model, *, text: str = "text", carry: list[Column] | None = None) -> DataFrame:
    """Columns `carry` of each row of `docs` (default: all, in a struct `row`), then lang_pred, score and usual.

    The score is the posterior of the best language under equal priors; a text of no learned language has one too.
    `usual` tells whether the text is, letter by letter, about as likely under that language as its labelled texts are. Null text, text without any letter, and every
    text if no language was learned, get `und`, 0 and false. Ties go to the language first by name. The whole text
    counts; repeated rows keep a row each; an empty table gives no rows.
    """
    carried = F.struct(*(carry if carry is not None else [docs[f"`{c}`"] for c in docs.columns]))
    rows = docs.select(F.coalesce(docs[text], F.lit("")).alias("body"), carried.alias("row"))
    schema = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("usual", T.BooleanType()), rows.schema["row"]])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        memo = Memo(lambda words: [row.tobytes() for row in model.score(words)])
        for part in slices(batches, 0):
            sums = _text_sums(model, memo, part.column(0).to_pylist())
            spoken = (sums[:, -1] > 0) & (len(model.languages) > 0)
            names, scores = np.full(len(sums), "und", object), np.zeros(len(sums))
            usual = np.zeros(len(sums), bool)
            if spoken.any():
                logs = sums[spoken, :-1]
                best, letters = logs.argmax(axis=1), sums[spoken, -1]
                names[spoken] = np.array(model.languages, object)[best]
                usual[spoken] = logs.max(axis=1) / letters >= model.floor(best, letters)
                scores[spoken] = 1.0 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(scores), pa.array(usual), part.column(1)],
                                              ["lang_pred", "score", "usual", "row"])

    return rows.mapInArrow(run, schema)
