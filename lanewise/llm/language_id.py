"""Language ID by unigram pieces, with all segmentations of a word summed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewise.llm import _memory as M
from lanewise.llm import _words as W

#: File of the public piece vocabulary.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Words up to so many characters are summed together with others of their length, longer ones by themselves.
LONGEST = 64
#: Labelled documents that the probabilities are learned from: for each language about so many, and
#: for all together; and bytes of their texts.
SAMPLE, SAMPLE_ALL, SAMPLE_BYTES = 500, 4000, 64 << 20
#: Probability of a character that is no piece, and rounds of expectation maximisation.
UNKNOWN, ROUNDS = 1e-7, 3
#: Bytes of scored words that a task remembers.
CACHE_BYTES = 32 << 20
MARK = "▁"

_STEP = np.uint64(0x9FB21C651E98DF25)


class Pieces:
    """The vocabulary's pieces as a hash table over runs of characters."""

    BITS = 20

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max((len(p) for p in pieces), default=1)
        names = np.zeros(len(pieces), np.uint64)
        for size in range(1, self.longest + 1):
            mine = [i for i, p in enumerate(pieces) if len(p) == size]
            if mine:
                code = np.frombuffer("".join(pieces[i] for i in mine).encode("utf-32-le"), "<u4").reshape(len(mine), size)
                h = np.zeros(len(mine), np.uint64)
                for j in range(size):
                    h = self.extend(h, code[:, j].astype(np.uint64))
                names[mine] = h
        self.names = np.append(names, 0)  # the last stands for no piece
        self.tables = []
        left, shift = np.arange(len(pieces)), 0
        while len(left):
            table = np.full(1 << self.BITS, len(pieces), np.int32)
            table[self.slot(names[left], shift)] = left
            self.tables.append((shift, table))
            left = left[table[self.slot(names[left], shift)] != left]
            shift += 7

    @staticmethod
    def extend(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        h = (h + code + np.uint64(1)) * _STEP
        return h ^ (h >> np.uint64(29))

    def slot(self, h: np.ndarray, shift: int) -> np.ndarray:
        return ((h >> np.uint64(shift)) & np.uint64((1 << self.BITS) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, or the number of pieces."""
        out = np.full(len(h), len(self.pieces), np.int32)
        for shift, table in self.tables:
            at = table[self.slot(h, shift)]
            same = (self.names[at] == h) & (at < len(self.pieces))
            out[same] = at[same]
        return out


def load_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, codes) of the words of each length, in runs of a bounded number."""
    size = np.array([len(w) for w in words])
    order = np.argsort(size, kind="stable")
    edges = np.flatnonzero(np.diff(size[order], prepend=-1)) if len(words) else []
    for a, b in zip(edges, [*edges[1:], len(words)]):
        for i in range(a, b, 4096):
            mine = order[i : min(b, i + 4096)]
            n = int(size[mine[0]])
            yield mine, np.frombuffer("".join(words[k] for k in mine).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(mine), n).astype(np.uint64)


def lattice(codes: np.ndarray, pieces: Pieces) -> list[list[np.ndarray]]:
    """For each start and length the piece of each word's run of characters (the number of pieces if it is none)."""
    n = codes.shape[1]
    out = []
    for s in range(n):
        h, row = np.zeros(len(codes), np.uint64), []
        for e in range(s, min(n, s + pieces.longest)):
            h = pieces.extend(h, codes[:, e])
            row.append(pieces.find(h))
        out.append(row)
    return out


def probabilities_with_none(p: np.ndarray) -> np.ndarray:
    return np.vstack([p, np.zeros((1, p.shape[1]))])


def forward(edges: list[list[np.ndarray]], p: np.ndarray, rows: int) -> np.ndarray:
    """Log probability of each word in each language: the sum over its segmentations into pieces.

    p has a last row of zeros for runs that are no piece; a single character that is none has
    UNKNOWN. Columns are scaled on the way, so long words don't vanish.
    """
    n, languages = len(edges), p.shape[1]
    ahead = [np.zeros((rows, languages)) for _ in range(n + 1)]
    ahead[0][:] = 1
    logs = np.zeros((rows, languages))
    none = len(p) - 1
    for s in range(n):
        here = ahead[s]
        if s % 8 == 7:
            scale = np.maximum(here, 1e-300)
            logs += np.log(scale)
            for later in range(s, min(n, s + len(edges[s]) + 16) + 1):
                ahead[later] = ahead[later] / scale
            here = ahead[s]
        for size, piece in enumerate(edges[s], 1):
            known = np.flatnonzero(piece != none)
            if len(known) == rows:
                ahead[s + size] += here * p[piece]
            elif len(known):
                ahead[s + size][known] += here[known] * p[piece[known]]
            if size == 1 and len(known) < rows:
                lost = np.flatnonzero(piece == none)
                ahead[s + 1][lost] += here[lost] * UNKNOWN
        if s:
            ahead[s] = here[:0]
    return logs + np.log(np.maximum(ahead[n], 1e-300))


def expected(edges: list[list[np.ndarray]], p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in one language over all segmentations of words so often seen."""
    n, rows, none = len(edges), len(weight), len(p) - 1
    q = [[np.where((size == 0) & (piece == none), UNKNOWN, p[piece]) for size, piece in enumerate(row)] for row in edges]
    ahead, back = np.zeros((n + 1, rows)), np.zeros((n + 1, rows))
    ahead[0], back[n] = 1, 1
    for s in range(n):
        for size, v in enumerate(q[s], 1):
            ahead[s + size] += ahead[s] * v
    for s in range(n - 1, -1, -1):
        for size, v in enumerate(q[s], 1):
            back[s] += v * back[s + size]
    total = np.maximum(ahead[n], 1e-300)
    uses = np.zeros(len(p))
    for s in range(n):
        for size, (piece, v) in enumerate(zip(edges[s], q[s]), 1):
            uses += np.bincount(piece, weights=weight * ahead[s] * v * back[s + size] / total, minlength=len(p))
    uses[none] = 0
    return uses


def spans(code: np.ndarray, pieces: Pieces) -> np.ndarray:
    """For each start and length - 1 the piece of one long word's run of characters (the number of pieces if it is none)."""
    out, h = np.full((len(code), pieces.longest), len(pieces.pieces), np.int32), np.zeros(len(code), np.uint64)
    for size in range(1, min(pieces.longest, len(code)) + 1):
        h = pieces.extend(h[: len(code) - size + 1], code[size - 1 :])
        out[: len(h), size - 1] = pieces.find(h)
    return out


def _long_sums(found: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log sums over the segmentations of a long word's first 0, 1, 2 ... characters (rows) in each language."""
    n, longest = found.shape
    logs = np.full((n + longest, p.shape[1]), -np.inf)  # the sum up to character e is at e + longest - 1
    logs[longest - 1] = 0
    sizes = np.arange(longest)
    for a in range(0, n, 4096):
        ends = np.arange(a, min(n, a + 4096))
        starts = ends[:, None] - sizes
        piece = np.where(starts >= 0, found[np.maximum(starts, 0), sizes], len(p) - 1)
        q = p[piece]
        q[:, 0][piece[:, 0] == len(p) - 1] = UNKNOWN
        for row, e in zip(q, ends.tolist()):
            before = logs[e : e + longest][::-1]
            top = before.max(axis=0)
            logs[e + longest] = top + np.log(np.maximum((np.exp(before - top) * row).sum(axis=0), 1e-300))
    return logs[longest - 1 :]


def long_forward(code: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """The same as forward, for one long word."""
    return _long_sums(spans(code, pieces), p)[-1]


def long_expected(code: np.ndarray, pieces: Pieces, p: np.ndarray, weight: float) -> np.ndarray:
    """The same as expected, for one long word."""
    found, none, n = spans(code, pieces), len(p) - 1, len(code)
    ahead = _long_sums(found, p[:, None])[:, 0]
    turned = np.full_like(found, none)
    for size in range(1, min(found.shape[1], n) + 1):
        turned[: n - size + 1, size - 1] = found[: n - size + 1, size - 1][::-1]
    back = _long_sums(turned, p[:, None])[::-1, 0]
    uses = np.zeros(len(p))
    for size in range(1, min(found.shape[1], n) + 1):
        piece = found[: n - size + 1, size - 1]
        uses += np.bincount(piece, weights=weight * p[piece] * np.exp(ahead[: n - size + 1] + back[size:] - ahead[-1]), minlength=len(p))
    uses[none] = 0
    return uses


def codes_of(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def learn(counts: pd.DataFrame, languages: list[str], pieces: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """Probabilities of the pieces in each language (columns), by expectation maximisation over
    words and how often each occurs; a last row of zeros."""
    size = len(pieces.pieces)
    out = np.zeros((size + 1, len(languages)))
    for k, language in enumerate(languages):
        mine = counts[counts.lang == language]
        usual, long = (mine[some] for some in (mine.word.str.len() <= LONGEST, mine.word.str.len() > LONGEST))
        weight = usual.n.to_numpy(dtype=float)
        lattices = [(places, lattice(codes, pieces)) for places, codes in by_length(usual.word.tolist())]
        p = np.append(np.full(size, 1.0 / size), 0)
        for _ in range(rounds):
            uses = np.zeros(size + 1)
            for places, edges in lattices:
                uses += expected(edges, p, weight[places])
            for word, n in zip(long.word, long.n):
                uses += long_expected(codes_of(word), pieces, p, float(n))
            uses[:size] += 0.02
            p = uses / uses.sum()
            p[size] = 0
        out[:, k] = p
    return out


def marked(word: bytes) -> str:
    """A word as the model sees it: lower case with a mark ahead."""
    return MARK + word.decode("utf-8", "replace").lower()


class Scorer:
    """Scores words, and remembers them."""

    def __init__(self, pieces: Pieces, p: np.ndarray):
        self.pieces, self.p = pieces, p
        self.names, self.scores = np.zeros(0, np.uint64), np.zeros((0, p.shape[1]))
        self.most = CACHE_BYTES // (8 + 8 * p.shape[1])

    def words(self, block: W.Block) -> np.ndarray:
        """Log probability of each word of the block in each language."""
        names, first, inverse = np.unique(block.hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.names, names)
        known = np.zeros(len(names), bool)
        inside = at < len(self.names)
        known[inside] = self.names[at[inside]] == names[inside]
        scores = np.zeros((len(names), self.p.shape[1]))
        scores[known] = self.scores[at[known]]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            raw = block.buf.tobytes()
            found = [marked(raw[a:b]) for a, b in zip(block.start[first[fresh]].tolist(), block.end[first[fresh]].tolist())]
            usual = [i for i, w in enumerate(found) if len(w) <= LONGEST]
            for places, codes in by_length([found[i] for i in usual]):
                scores[fresh[np.array(usual)[places]]] = forward(lattice(codes, self.pieces), self.p, len(codes))
            for i, w in enumerate(found):
                if len(w) > LONGEST:
                    scores[fresh[i]] = long_forward(codes_of(w), self.pieces, self.p)
            names_all = np.concatenate([self.names, names[fresh]]) if len(self.names) + len(fresh) <= self.most else names
            scores_all = np.concatenate([self.scores, scores[fresh]]) if len(self.names) + len(fresh) <= self.most else scores
            order = np.argsort(names_all)
            self.names, self.scores = names_all[order][: self.most], scores_all[order][: self.most]
        return scores[inverse]


def _predict(pieces: list[str], p: np.ndarray, prior: np.ndarray, languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Pieces(pieces), p) if languages else None
        letters = np.zeros(256, bool)
        letters[0x41:0x5B] = letters[0x61:0x7B] = True
        for batch in batches:
            best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            for block in W.blocks(batch.column("text"), W.SPACED, 2 << 20) if scorer else ():
                sums = np.concatenate([[0], np.cumsum(letters[block.buf])])
                lettered = sums[block.text_at[1:]] > sums[block.text_at[:-1]]
                for t in np.flatnonzero(~lettered).tolist():
                    lettered[t] = any(c.isalpha() for c in block.buf[block.text_at[t] : block.text_at[t + 1]].tobytes().decode("utf-8", "replace"))
                each = np.vstack([np.zeros((1, len(languages))), np.cumsum(scorer.words(block), axis=0)])
                total = each[block.word_at[1:]] - each[block.word_at[:-1]] + prior
                odds = np.exp(total - total.max(axis=1, keepdims=True))
                rows = block.first + np.flatnonzero(lettered)
                best[rows] = total.argmax(axis=1)[lettered]
                score[rows] = (1 / odds.sum(axis=1))[lettered]
            names = pa.array([languages[i] if i >= 0 else "und" for i in best.tolist()], pa.string())
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), names, pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[tuple[str, str], int] = {}
        for language, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            for word in (text or "").encode("utf-8", "replace").split():
                key = language, marked(word)
                counts[key] = counts.get(key, 0) + 1
        yield pa.record_batch([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, vocabulary: str | list[str] = VOCABULARY, sample: int = SAMPLE, columns: tuple[str, str, str] = ("doc_id", "text", "lang")) -> DataFrame:
    """For each row of docs: doc_id, held_out, lang_pred, score (probability of that language).

    Each language has its own probabilities of the pieces of a fixed public vocabulary (the path of
    its file, or its pieces). A word,
    in lower case, has in each language the sum over all its segmentations into pieces, by the
    forward algorithm; a text has the product over its words (parted by ASCII white space).

    Learns from the text and language of rows that are not held out: shares of languages from all
    of them, piece probabilities from about ``sample`` documents of each language (fewer of each
    beyond SAMPLE_ALL together), those of smallest hash. Prediction reads the text alone.

    Null text, or text without letters: und, score 0; so is every text if no row has a language to
    learn from. Rows alike are predicted alike; a row without id counts as not held out. An empty
    table gives an empty result. Other columns are ignored.
    """
    doc_id, text, lang = columns
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), is_held_out(F.col(doc_id)).alias("held_out"))
    labelled = rows.filter("not held_out and lang is not null and text is not null")
    shares = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(shares)
    pieces = load_pieces(vocabulary) if isinstance(vocabulary, str) else vocabulary
    p, prior = np.zeros((len(pieces) + 1, len(languages))), np.zeros(len(languages))
    if languages:
        each = max(20, min(sample, SAMPLE_ALL // len(languages)))
        place = F.pmod(F.xxhash64("doc_id", F.lit("learn")), F.lit(1 << 30)) / float(1 << 30)
        share = F.create_map(*[F.lit(x) for k in languages for x in (k, each / shares[k])])[F.col("lang")]
        by_place = Window.partitionBy("lang").orderBy("place", F.xxhash64("text"))
        chosen = labelled.withColumn("place", place).filter(F.col("place") < share)
        chosen = chosen.withColumn("earlier", F.sum(F.octet_length("text")).over(by_place) - F.octet_length("text"))
        chosen = chosen.filter(F.col("earlier") < SAMPLE_BYTES // len(languages)).select("lang", "text")
        counts = chosen.mapInArrow(M.batches(_word_counts), "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
        p = learn(counts, languages, Pieces(pieces))
        prior = np.log(np.array([shares[k] for k in languages]) / sum(shares.values()))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "held_out", "text").mapInArrow(M.batches(_predict(pieces, p, prior, languages)), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
