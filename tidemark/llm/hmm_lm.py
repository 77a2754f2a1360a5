"""Hidden Markov language model with exact sequence likelihoods.

A text is its lower-case words and one end token. Latent states emit words,
each word with probabilities of its own::

    P(text) = sum over state paths of  prod P(z|z') P(word|z)
    P(word|z) = P(z|word) P(word) / P(z)

``P(z|word)`` is the word's expected count in state z over all its training
places, drawn towards the share of the word's class by ``DRAWN`` counts; a
word without training places has its class's. Classes (the end, each of the
most frequent words, others by their last bytes) are also what the first
iterations train, as those find the states on few numbers.

Tasks number the words of blocks of documents, so only a block's distinct
words move, never its documents: they are counted by word hash, and the
counts come back as a table of the block in the shared folder. Baum-Welch
then runs over blocks. Each task adds up expected counts of whole sequences;
those of starts, moves and classes are summed to the driver (states x
classes), those of words by word hash, and the new probabilities become the
block's next table. Scoring is the scaled forward recursion over each whole
sequence.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_fs, remove, shared_dir, stored
from .groups import arrow_schema, clustered, record_batch, runs

#: Iterations of Baum-Welch over classes, and then over words.
STATES, ITERATIONS, WORD_ITERATIONS = 6, 3, 2
#: Words with a class of their own: at most so many, each at least this
#: share of the training tokens. Other words share the suffix classes.
OWN_WORDS, OWN_SHARE, SUFFIX_CLASSES, SUFFIX_BYTES = 180, 0.001, 75, 3
CLASSES = 1 + OWN_WORDS + SUFFIX_CLASSES
END = 0
#: Bytes of text whose words a task numbers at once, and tokens it runs at once.
BLOCK_BYTES, BATCH_TOKENS = 24 << 20, 300_000
SMOOTH = 0.01
#: Steps of the recursions between two scalings. A row of moves sums to 1, so a
#: step keeps at least the symbol's least emission: over SMOOTH / tokens, far
#: from underflow in so many steps.
RESCALED = 8
#: Tokens of the backward recursion whose counts are added up at once.
WINDOW_TOKENS = 1 << 14
#: Counts by which a word's states are drawn towards those of its class.
DRAWN = 5.0
#: Bytes of text that are cut into words at once.
PIECE_BYTES = 4 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SEPARATES = np.isin(np.arange(256), [32, *range(9, 14)])


def cut(texts: list[bytes]) -> tuple:
    """Words of UTF-8 texts, end to end as a dictionary array of pyarrow, and how many each text has.

    Words are runs without blank, tab or line break, A-Z lower-cased.
    """
    import pyarrow as pa

    # A blank before the first text and after each.
    data = np.frombuffer(b" ".join([b"", *texts, b""]).translate(_LOWER), np.uint8)
    inside = ~_SEPARATES[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    firsts = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return words.dictionary_encode(), np.diff(np.searchsorted(starts, firsts))


def numbered_words(pieces: list[tuple]) -> tuple[list[bytes], list[np.ndarray]]:
    """The distinct words of texts that ``cut`` has cut, as they first appear,
    and their numbers (int32) text by text. Empties ``pieces``."""
    import pyarrow as pa

    if not pieces:
        return [], []
    # Words of pieces, one after another, are numbered like those of texts.
    found = pa.concat_arrays([p.dictionary for p, _ in pieces]).dictionary_encode()
    numbers, at, ids = found.indices.to_numpy(), 0, []
    for i, (piece, lengths) in enumerate(pieces):
        pieces[i] = None
        ids += np.split(numbers[at : at + len(piece.dictionary)][piece.indices.to_numpy()], np.cumsum(lengths)[:-1])
        at += len(piece.dictionary)
    pieces.clear()
    _, offsets, data = found.dictionary.buffers()
    offsets, data = np.frombuffer(offsets, np.int64)[: len(found.dictionary) + 1].tolist(), data.to_pybytes() if data else b""
    return [data[a:z] for a, z in zip(offsets, offsets[1:])], ids


def suffix_class(word: bytes) -> int:
    return 1 + OWN_WORDS + zlib.crc32(word[-SUFFIX_BYTES:]) % SUFFIX_CLASSES


# ---------------------------------------------------------------- the model


class HMM:
    """Start, transition and emission probabilities over classes.

    ``emissions`` of its methods, a row of states for each symbol, take the
    place of the classes' where symbols are others.
    """

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def initial(cls, states: int = STATES, classes: int = CLASSES, seed: int = 11) -> HMM:
        rng = np.random.default_rng(seed)
        start, move, emit = (1 + rng.random(shape) for shape in (states, (states, states), (states, classes)))
        emit *= 1 + 3 * (rng.random(emit.shape) < 0.3)
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))

    def forward(self, sequences: list[np.ndarray], keep: bool = False, emissions: np.ndarray | None = None):
        """Scaled forward recursion of sequences, none empty, in falling length.

        Returns their log-likelihoods and, with ``keep``, what the backward
        pass needs. Step t runs on all sequences longer than t at once.
        """
        lengths = np.array([len(s) for s in sequences], dtype=np.int64)
        steps = int(lengths[0]) if len(lengths) else 0
        active = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")
        starts = np.concatenate(([0], np.cumsum(active)))
        # Tokens step by step: all first ones, all second ones, and so on.
        at = np.empty(starts[-1], dtype=np.intp)
        of = np.repeat(np.arange(len(lengths)), lengths)
        at[starts[np.arange(len(of)) - (np.cumsum(lengths) - lengths)[of]] + of] = np.concatenate([np.zeros(0, np.uint8), *sequences])
        alphas = (self.emit.T.copy() if emissions is None else emissions).take(at, axis=0)
        logs, scales, ones = np.zeros(len(sequences)), {}, np.ones(len(self.start))
        bounds, before = starts.tolist(), None
        for t in range(steps):
            now = alphas[bounds[t] : bounds[t + 1]]
            now *= self.start if t == 0 else before[: len(now)].dot(self.move)
            if t % RESCALED == RESCALED - 1:
                total = scales[t] = now.dot(ones)
                now /= total[:, None]
                logs[: len(now)] += np.log(total)
            before = now
        ends = alphas[starts[lengths - 1] + np.arange(len(lengths))].dot(ones)
        logs += np.log(ends)
        return (logs, (alphas, scales, ends, at, starts, active)) if keep else logs

    def expected(self, sequences: list[np.ndarray], emissions: np.ndarray | None = None, symbols: np.ndarray | None = None) -> np.ndarray:
        """Expected counts of one Baum-Welch step: start, moves, emissions, log-likelihood.

        Given ``symbols``, a row for each state, those of emissions are added to it instead.
        """
        k = len(self.start)
        logs, (alphas, scales, ends, at, starts, active) = self.forward(sequences, True, emissions)
        table = self.emit.T.copy() if emissions is None else emissions
        found = np.zeros((k, len(table))) if symbols is None else symbols
        bounds, back, last = starts.tolist(), self.move.T.copy(), 1 / ends
        first, moves, later, end = np.zeros(k), np.zeros((k, k)), alphas[:0], len(active)
        while end:
            # Steps begin to end, some WINDOW_TOKENS, from the last ones to the first.
            begin = min(end - 1, int(np.searchsorted(starts, bounds[end] - WINDOW_TOKENS)))
            low, high = bounds[begin], bounds[end]
            after, gammas = table.take(at[low:high], axis=0), np.empty((high - low, k))
            for t in range(end - 1, begin - 1, -1):
                a, b = bounds[t] - low, bounds[t + 1] - low
                n, beta = len(later), gammas[a:b]
                np.dot(later, back, out=beta[:n])
                beta[n:] = last[n : b - a, None]
                later = after[a:b]
                later *= beta
                if t in scales:
                    later /= scales[t][:, None]
            into = max(begin, 1)
            before = np.arange(bounds[into], high) - np.repeat(active[into - 1 : end - 1], active[into:end])
            moves += alphas.take(before, axis=0).T @ after[bounds[into] - low :]
            gammas *= alphas[low:high]
            for s in range(k):
                np.add.at(found[s], at[low:high], gammas[:, s])
            if begin == 0:
                first = gammas[: active[0]].sum(axis=0)
            end = begin
        return np.concatenate((first, (moves * self.move).ravel(), found.ravel() if symbols is None else found[:0, 0], [logs.sum()]))

    def updated(self, counts: np.ndarray) -> tuple[HMM, float]:
        """The model that maximises the expected counts, and the log-likelihood before."""
        k, c = self.emit.shape
        start, move, emit = counts[:k] + SMOOTH, counts[k : k + k * k].reshape(k, k) + SMOOTH, counts[k + k * k : -1].reshape(k, c) + SMOOTH
        return HMM(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True)), float(counts[-1])


def batched(sequences: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Places of sequences of like length, some ``BATCH_TOKENS`` at once."""
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    part, size = [], 0
    for i in order.tolist():
        part.append(i)
        size += len(sequences[i])
        if size >= BATCH_TOKENS:
            yield np.array(part)
            part, size = [], 0
    if part:
        yield np.array(part)


# ---------------------------------------------------------------- counting


def _numbered(docs: DataFrame, buckets: int) -> DataFrame:
    """Blocks of documents with numbered words, in one pass.

    Rows of kind ``doc``: block, doc_id, train, ids (int32 numbers of the
    words). Rows of kind ``words``: block, bucket (by word hash), the
    words joined by line breaks and their training counts in the block.
    Words are numbered bucket by bucket, so a block's counts are those of
    its buckets laid end to end.
    """
    slim = docs.select("doc_id", "text", held_out(F.col("doc_id"), 7).alias("held"), F.col("doc_id").isNotNull().alias("named"))
    schema = T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), slim.schema["doc_id"],
        T.StructField("held", T.BooleanType()), T.StructField("train", T.BooleanType()), T.StructField("data", T.BinaryType()), T.StructField("counts", T.BinaryType()),
    ])
    target = _arrow(schema)

    def run(batches: Iterable):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        squeeze = zstandard.ZstdCompressor(level=1).compress
        block = TaskContext.get().partitionId() << 32
        waiting, texts, pieces, size, uncut = [], [], [], 0, 0

        def close():
            nonlocal waiting, size, block
            words, numbers = numbered_words(pieces)
            hashed = np.fromiter((zlib.crc32(w) for w in words), dtype=np.uint32, count=len(words)) % np.uint32(buckets)
            order = np.argsort(hashed, kind="stable")
            renumbered = np.empty(len(words), dtype=np.int32)
            renumbered[order] = np.arange(len(words), dtype=np.int32)
            counts = np.zeros(len(words), dtype=np.int64)
            rows = []
            for (doc_id, held, train), ids in zip(waiting, numbers):
                ids = renumbered[ids]
                if train:
                    np.add.at(counts, ids, 1)
                rows.append(("doc", block, -1, doc_id, held, train, squeeze(ids.tobytes()), None))
                if len(rows) == 2000:
                    yield record_batch(rows, target)
                    rows = []
            cuts = np.searchsorted(hashed[order], np.arange(buckets + 1))
            for b in range(buckets):
                own = order[cuts[b] : cuts[b + 1]]
                if len(own):
                    rows.append(("words", block, b, None, None, None, squeeze(b"\n".join([words[i] for i in own.tolist()])), squeeze(counts[cuts[b] : cuts[b + 1]].tobytes())))
            if rows:
                yield record_batch(rows, target)
            waiting, size, block = [], 0, block + 1

        for batch in batches:
            for doc_id, text, held, named in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                texts.append(text.as_py() or b"")
                waiting.append((doc_id, held, named and not held))
                size += len(texts[-1]) + 100
                uncut += len(texts[-1]) + 100
                if uncut >= PIECE_BYTES or size >= BLOCK_BYTES:
                    pieces.append(cut(texts))
                    texts, uncut = [], 0
                if size >= BLOCK_BYTES:
                    yield from close()
        if texts:
            pieces.append(cut(texts))
        if waiting:
            yield from close()

    return stored(slim.mapInArrow(run, schema), "numbered")


def _arrow(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def held_out(doc_id, folds: int):
    """True where the id's crc32 leaves 2; a null id is not held out, nor learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 2, F.lit(False))


def _own_words(numbered: DataFrame) -> list[bytes]:
    """The words with a class of their own, by falling training count.

    A word with the least share overall has it in some block, so blocks
    offer such words and only those are counted over all blocks.
    """
    def offered(batches):
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for data, counts, total in zip(*(c.to_pylist() for c in batch.columns)):
                n = np.frombuffer(open_(counts), dtype=np.int64)
                often = np.flatnonzero(n >= max(1, OWN_SHARE * total))
                if len(often):
                    words = open_(data).split(b"\n")
                    rows += [(words[i], int(n[i])) for i in often.tolist()]
            if rows:
                yield record_batch(rows, target)

    target = arrow_schema("word binary, n long")
    docs, words = numbered.where("kind = 'doc'"), numbered.where("kind = 'words'")
    sizes = _block_tokens(docs)
    joined = words.join(sizes, "block").select("data", "counts", "tokens")
    names = stored(joined.mapInArrow(offered, "word binary, n long").select("word").distinct(), "offered")
    total = (sizes.agg(F.sum("tokens")).first()[0] or 0) + docs.where("train").count()
    best: dict[bytes, int] = {}
    # Offered words are few (shares of 1/1000); count them exactly, in parts.
    n = names.count()
    parts = max(1, -(-n // 50_000))
    for p in range(parts):
        part = {bytes(r.word) for r in names.where(F.pmod(F.xxhash64("word"), F.lit(parts)) == p).collect()}
        shared = numbered.sparkSession.sparkContext.broadcast(part)

        def counted(batches, shared=shared):
            import zstandard

            open_ = zstandard.ZstdDecompressor().decompress
            sums: dict[bytes, int] = defaultdict(int)
            for batch in batches:
                for data, counts in zip(*(c.to_pylist() for c in batch.columns)):
                    words = open_(data).split(b"\n")
                    hits = [i for i, w in enumerate(words) if w in shared.value]
                    if hits:
                        n = np.frombuffer(open_(counts), dtype=np.int64)
                        for i in hits:
                            sums[words[i]] += int(n[i])
            if sums:
                yield record_batch(list(sums.items()), target)

        counts = words.select("data", "counts").mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
        for r in counts.where(F.col("n") >= OWN_SHARE * total).orderBy(F.desc("n"), "word").limit(OWN_WORDS).collect():
            best[bytes(r.word)] = r.n
    return [w for w, _ in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:OWN_WORDS]]


def _block_tokens(docs: DataFrame) -> DataFrame:
    """(block, tokens): training words in each block."""
    def run(batches):
        import zstandard

        for batch in batches:
            sums: dict[int, int] = defaultdict(int)
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[block] += zstandard.frame_content_size(data) // 4
            if sums:
                yield record_batch(list(sums.items()), target)

    target = arrow_schema("block long, tokens long")
    return docs.where("train").select("block", "data").mapInArrow(run, "block long, tokens long").groupBy("block").agg(F.sum("tokens").alias("tokens"))


def _counted(numbered: DataFrame, own: list[bytes]) -> DataFrame:
    """Training counts of all words, back in their blocks.

    Rows of kind ``counts``: block, bucket, counts (int64), classes and
    places among the bucket's words (int32), all of the block's words in that
    bucket in order. Rows of kind ``bucket``: counts and classes of the
    bucket's words by place. Rows of kind ``total``: class in ``bucket``, ``n``
    training tokens and ``v`` distinct ones.
    """
    words = clustered(numbered.where("kind = 'words'").select("bucket", "block", "data", "counts"), ["bucket"], ("block",))
    schema = "kind string, block long, bucket int, counts binary, classes binary, places binary, n long, v long"
    target = arrow_schema(schema)
    class_of = {w: i + 1 for i, w in enumerate(own)}

    def run(batches):
        import zstandard

        open_, squeeze = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        for group in runs(batches, ["bucket"]):
            bucket, blocks = group.column("bucket")[0].as_py(), group.column("block").to_pylist()
            number: dict[bytes, int] = defaultdict()
            number.default_factory = number.__len__
            ids, pieces = [], []
            for data, counts in zip(group.column("data"), group.column("counts")):
                ids.append(np.fromiter(map(number.__getitem__, open_(data.as_py()).split(b"\n")), dtype=np.int64))
                pieces.append(np.frombuffer(open_(counts.as_py()), dtype=np.int64))
            totals = np.zeros(len(number), dtype=np.int64)
            for i, n in zip(ids, pieces):
                totals[i] += n  # a block names a word once
            classes = np.fromiter((class_of.get(w) or suffix_class(w) for w in number), dtype=np.uint8, count=len(number))
            rows = [("counts", block, bucket, squeeze(totals[i].tobytes()), squeeze(classes[i].tobytes()), squeeze(i.astype(np.int32).tobytes()), None, None) for block, i in zip(blocks, ids)]
            seen = totals > 0
            n, v = np.bincount(classes, totals, CLASSES).astype(np.int64), np.bincount(classes[seen], minlength=CLASSES)
            rows.append(("bucket", None, bucket, squeeze(totals.tobytes()), squeeze(classes.tobytes()), None, None, None))
            rows += [("total", None, c, None, None, None, int(n[c]), int(v[c])) for c in np.flatnonzero(v).tolist()]
            yield record_batch(rows, target)

    return stored(words.mapInArrow(run, schema), "counts")


class Vocabulary:
    """What needs only training counts: totals, and by class what a word's
    probability is made of."""

    def __init__(self, numbered: DataFrame, counted: DataFrame):
        n, v = np.zeros(CLASSES), np.zeros(CLASSES)
        for r in counted.where("kind = 'total'").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
            n[r.bucket], v[r.bucket] = r.n, r.v
        n[END] = self.ends = numbered.where("kind = 'doc' AND train").count()
        v[END] = float(self.ends > 0)
        self.tokens, self.distinct = int(n.sum()), int(v.sum())
        self.class_share = (n + SMOOTH) / (n + SMOOTH).sum()
        # All unseen words of a class are one more of its distinct words.
        self.unseen = self.class_share / (n + v + 1)
        self.log_base = np.log10(self.tokens + self.distinct + 1)

    def word_share(self, counts, classes):
        """P(word) of words with so many training places."""
        return (counts + 1) * self.unseen[classes]


class States:
    """The moves between states, and which states a word is in.

    ``prior`` is P(z|class) and ``mass`` P(z). A word's emissions are
    P(z|word) / P(z); P(word) is the same in all states and stands outside.
    """

    def __init__(self, moves: HMM, prior: np.ndarray, mass: np.ndarray):
        self.moves, self.prior, self.mass = moves, prior, mass

    @classmethod
    def of_classes(cls, model: HMM, counts: np.ndarray | None, vocabulary: Vocabulary) -> States:
        """All words as their class, whose expected counts ``counts`` holds."""
        k, c = model.emit.shape
        by_class = model.emit if counts is None else counts[k + k * k : -1].reshape(k, c) + SMOOTH
        prior = (by_class / by_class.sum(axis=0)).T
        return cls(model, prior, vocabulary.class_share @ prior)

    def of_words(self, counts: np.ndarray, vocabulary: Vocabulary, seen: np.ndarray) -> States:
        """After an iteration over words; ``seen`` sums P(word) P(z|word) over words with training places."""
        k = len(self.mass)
        start, move = counts[:k] + SMOOTH, counts[k : k + k * k].reshape(k, k) + SMOOTH
        moves = HMM(start / start.sum(), move / move.sum(axis=1, keepdims=True), self.moves.emit)
        return States(moves, self.prior, seen + vocabulary.unseen[1:] @ self.prior[1:] + vocabulary.class_share[END] * self.prior[END])

    def emissions(self, table: Table) -> np.ndarray:
        """A row for each word of the table, and one for the end."""
        return np.concatenate((self.prior[table.classes] if table.states is None else table.states, self.prior[END:1])) / self.mass


# ---------------------------------------------------------------- tables of blocks


#: Parts of 1 in which probabilities and shares of a word's states are kept.
PARTS = 65_535


def _laid(rows: list[dict], column: str, kind) -> np.ndarray:
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(open_(r[column]), kind) for r in rows)])


class Table:
    """A block's words: training counts, classes and, from the first iteration
    over words on, P(z|word); ``cuts`` are the first words of ``buckets``."""

    def __init__(self, rows: list[dict], later: list[dict] | None, states: int):
        import zstandard

        self.counts, self.classes = _laid(rows, "counts", np.int64), _laid(rows, "classes", np.uint8)
        self.buckets = [r["bucket"] for r in rows]
        self.cuts = np.cumsum([0, *(zstandard.frame_content_size(r["classes"]) for r in rows)])
        self.states = None if later is None else _laid(later, "states", np.uint16).reshape(-1, states) / PARTS


class Folder:
    """Rows by block in a folder that all executors share.

    A block's rows lie in the folder of its home, in order, and tasks read
    them from there by the row groups' bounds; so documents stay where they
    are while words' numbers change. Rows without a block are read by Spark.
    """

    def __init__(self, rows: DataFrame, what: str):
        self.spark, self.schema = rows.sparkSession, rows.schema
        self.path, self.homes = shared_dir(self.spark, what), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # Blocks of a task have its number above bit 32.
        home = F.pmod(F.shiftright("block", 32) + F.col("block").bitwiseAND(F.lit((1 << 32) - 1)), F.lit(self.homes))
        placed = rows.withColumn("home", F.coalesce(home, F.pmod(F.spark_partition_id(), F.lit(self.homes))).cast("int"))
        clustered(placed, ["home"], ("block", "bucket")).write.partitionBy("home").option("parquet.block.size", 8 << 20).parquet(self.path)

    def __getstate__(self) -> dict:
        return {"path": self.path, "homes": self.homes}

    def without_block(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).where("block IS NULL")

    def read(self, block: int) -> list[dict]:
        import pyarrow.dataset as ds
        from pyarrow import fs

        files, root = arrow_fs(self.path)
        home = ((block >> 32) + (block & (1 << 32) - 1)) % self.homes
        found = files.get_file_info(fs.FileSelector(f"{root}/home={home}", allow_not_found=True))
        names = [f.path for f in found if f.path.endswith(".parquet")]
        if not names:
            return []
        rows = ds.dataset(names, format="parquet", filesystem=files).to_table(filter=ds.field("block") == block)
        return sorted(rows.to_pylist(), key=lambda r: r["bucket"])

    def remove(self) -> None:
        remove(self.spark, self.path)


class Tables:
    """The tables of all blocks: what never changes, and the states of the last iteration."""

    def __init__(self, words: Folder, states: Folder | None = None):
        self.words, self.states = words, states

    @classmethod
    def of(cls, counted: DataFrame) -> Tables:
        return cls(Folder(counted.where("kind = 'counts'").select("block", "bucket", "counts", "classes"), "word-tables"))

    def read(self, block: int, states: int) -> Table:
        return Table(self.words.read(block), self.states and self.states.read(block), states)


def _documents(numbered: DataFrame) -> DataFrame:
    return numbered.where("kind = 'doc'").select("block", "doc_id", "held", "train", "data")


def _ids(column) -> list[np.ndarray]:
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    return [np.frombuffer(open_(x), dtype=np.int32) for x in column.to_pylist()]


def _expected(docs: DataFrame, states: States | HMM, tables: Tables) -> DataFrame:
    """Expected counts of the documents: rows (at, x) for starts, moves,
    classes and the log-likelihood, with a bucket below 0; where ``states``
    holds the words' states, also rows (block, bucket, data, counts) for the
    words of a bucket: their places in these documents and the shares of the
    states in them."""
    shared = docs.sparkSession.sparkContext.broadcast((states, tables))
    schema = "at int, x double, block long, bucket int, data binary, counts binary"
    target = arrow_schema(schema)

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        squeeze = zstandard.ZstdCompressor(level=1).compress
        states, tables = shared.value
        task = -1 - TaskContext.get().partitionId() % tables.words.homes
        by_word = isinstance(states, States)
        model = states.moves if by_word else states
        k, total = len(model.start), None
        for group in runs(batches, ["block"]):
            block = group.column("block")[0].as_py()
            table = tables.read(block, k)
            ids = _ids(group.column("data"))
            words = len(table.classes)
            emissions = states.emissions(table) if by_word else None
            sequences = [np.append(i, np.int32(words)) for i in ids] if by_word else [np.append(table.classes[i], np.uint8(END)) for i in ids]
            of_words = np.zeros((k, words + 1)) if by_word else None
            for part in batched(sequences):
                counts = model.expected([sequences[i] for i in part], emissions, of_words)
                total = counts if total is None else total + counts
            if by_word and words:
                places = np.bincount(np.concatenate(ids), minlength=words).astype(np.int32)
                shares = of_words[:, :-1].T / np.maximum(places, 1)[:, None]
                shares = np.rint(np.minimum(shares, 1) * PARTS).astype(np.uint16)
                yield record_batch([(None, None, block, b, squeeze(shares[a:z].tobytes()), squeeze(places[a:z].tobytes())) for b, a, z in zip(table.buckets, table.cuts, table.cuts[1:])], target)
        if total is not None:
            yield record_batch([(i, x, None, task, None, None) for i, x in enumerate(total.tolist())], target)

    return docs.select("block", "data").mapInArrow(run, schema)


def _summed(found: DataFrame, size: int) -> np.ndarray:
    counts = np.zeros(size)
    for r in found.where("at IS NOT NULL").groupBy("at").agg(F.sum("x").alias("x")).collect():
        counts[r["at"]] = r.x
    return counts


def baum_welch(docs: DataFrame, tables: Tables, iterations: int = ITERATIONS, model: HMM | None = None) -> tuple[HMM, np.ndarray | None, list[float]]:
    """Train over classes: the model, the last expected counts and the log-likelihoods.

    Each task adds up expected counts over its sequences; Spark sums them by
    place, and the driver gets one number for each of the model's.
    """
    model, counts, history = model or HMM.initial(), None, []
    for _ in range(iterations):
        k, c = model.emit.shape
        counts = _summed(_expected(docs, model, tables), k + k * k + k * c + 1)
        model, before = model.updated(counts)
        history.append(before)
    return model, counts, history


def _word_iteration(docs: DataFrame, counted: DataFrame, states: States, tables: Tables, vocabulary: Vocabulary) -> tuple[States, Tables]:
    """One iteration of Baum-Welch in which every word has its own emissions.

    One job: expected counts go to the words' buckets, new states back to the
    blocks. What the driver sums up rides along as rows without a block.
    """
    k = len(states.mass)
    schema = "at int, x double, block long, bucket int, data binary, counts binary"
    columns = [x.split() for x in schema.split(", ")]
    binary = F.lit(None).cast("binary")

    def rows_of(kind, order, *given, data=binary, classes=binary):
        own = [F.col(c) if c in given else data.alias(c) if c == "data" else F.lit(None).cast(t).alias(c) for c, t in columns]
        return counted.where(F.col("kind") == kind).select(*own, F.lit(order).alias("order"), classes.alias("classes"))

    words = rows_of("bucket", 0, "bucket", "counts", classes=F.col("classes"))
    places = rows_of("counts", 1, "block", "bucket", data=F.col("places"))
    found = _expected(docs, states, tables).withColumn("order", F.lit(2)).withColumn("classes", binary)
    rows = clustered(found.unionByName(words).unionByName(places), ["bucket"], ("block", "order"))
    shared = docs.sparkSession.sparkContext.broadcast((states.prior, vocabulary))
    out = "at int, x double, block long, bucket int, states binary"
    target = arrow_schema(out)

    def run(batches):
        import zstandard

        open_, squeeze = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        prior, vocabulary = shared.value
        mass, sums = np.zeros(k), np.zeros(k + k * k + 1)
        for group in runs(batches, ["bucket"]):
            bucket = group.column("bucket")[0].as_py()
            if bucket < 0:
                np.add.at(sums, group.column("at").to_numpy(), group.column("x").to_numpy())
                continue
            # A bucket's own row has no block and comes first; then each block's
            # places and, as its documents may have been in two tasks, its counts.
            n, c = np.frombuffer(open_(group.column("counts")[0].as_py()), np.int64), np.frombuffer(open_(group.column("classes")[0].as_py()), np.uint8)
            of_words, blocks = np.zeros((len(n), k)), []
            for i in range(1, group.num_rows):
                data = open_(group.column("data")[i].as_py())
                if group.column("order")[i].as_py() == 1:
                    blocks.append((group.column("block")[i].as_py(), np.frombuffer(data, np.int32)))
                else:
                    shares = np.frombuffer(data, np.uint16).reshape(-1, k).astype(np.float64)
                    here = np.frombuffer(open_(group.column("counts")[i].as_py()), np.int32)
                    of_words[blocks[-1][1]] += shares * (here / np.maximum(shares.sum(axis=1), 1))[:, None]  # a block names a word once
            drawn = of_words + DRAWN * prior[c]
            drawn = np.maximum(np.rint(drawn / drawn.sum(axis=1, keepdims=True) * PARTS), 1).astype(np.uint16)
            seen = n > 0
            mass += vocabulary.word_share(n[seen], c[seen]) @ (drawn[seen] / PARTS)
            for block, at in blocks:
                yield record_batch([(None, None, block, bucket, squeeze(drawn[at].tobytes()))], target)
        yield record_batch([(i, x, None, None, None) for i, x in enumerate([*sums.tolist(), *mass.tolist()])], target)

    new = Folder(rows.mapInArrow(run, out), "word-states")
    sums = _summed(new.without_block(), k + k * k + 1 + k)
    if tables.states:
        tables.states.remove()
    return states.of_words(sums[:-k], vocabulary, sums[-k:]), Tables(tables.words, new)


def trained(docs: DataFrame, counted: DataFrame, vocabulary: Vocabulary, states: int, iterations: int, word_iterations: int) -> tuple[States, Tables]:
    """Baum-Welch over classes, then over words, on all rows of ``docs``."""
    tables = Tables.of(counted)
    model, counts, _ = baum_welch(docs, tables, iterations, HMM.initial(states))
    found = States.of_classes(model, counts, vocabulary)
    for _ in range(word_iterations):
        found, tables = _word_iteration(docs, counted, found, tables, vocabulary)
    return found, tables


def score_texts(docs: DataFrame, states: int = STATES, iterations: int = ITERATIONS, word_iterations: int = WORD_ITERATIONS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score.

    ``docs`` needs doc_id and text; other columns are ignored. Null text is
    the empty text, which is one token, its end. Rows with a null id are
    scored but not learnt from; repeated rows count and score each. Without
    training rows every token is unknown and scores are those of the
    untrained model. ``score`` is the log10 probability of the whole text.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = _numbered(docs, buckets)
    counted = _counted(numbered, _own_words(numbered))
    vocabulary = Vocabulary(numbered, counted)
    found, tables = trained(_documents(numbered).where("train"), counted, vocabulary, states, iterations, word_iterations)
    shared = spark.sparkContext.broadcast((found, tables, vocabulary))
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])
    target = _arrow(schema)

    def run(batches):
        found, tables, vocabulary = shared.value
        k, ends = len(found.mass), vocabulary.ends
        for group in runs(batches, ["block"]):
            table = tables.read(group.column("block")[0].as_py(), k)
            emissions = found.emissions(table)
            known, log_base = table.counts > 0, np.log10(table.counts + 1) - vocabulary.log_base
            log_word = np.log10(vocabulary.word_share(table.counts, table.classes))
            end_base, end_word = np.log10(ends + 1) - vocabulary.log_base, np.log10(vocabulary.word_share(ends, END))
            ids = _ids(group.column("data"))
            sequences = [np.append(i, np.int32(len(known))) for i in ids]
            logs = np.zeros(len(ids))
            for part in batched(sequences):
                logs[part] = found.moves.forward([sequences[i] for i in part], emissions=emissions)
            logs /= np.log(10)
            rows = [
                (doc_id, held, len(i) + 1, int(known[i].sum()) + (ends > 0), vocabulary.tokens, float(log_base[i].sum() + end_base), float(log_word[i].sum() + end_word + log))
                for doc_id, held, i, log in zip(group.column("doc_id").to_pylist(), group.column("held").to_pylist(), ids, logs.tolist())
            ]
            for at in range(0, len(rows), 5000):
                yield record_batch(rows[at : at + 5000], target)

    return _documents(numbered).mapInArrow(run, schema)
