"""Masked pseudo-likelihood scores from a bidirectional window network.

Tokens are words (runs without white space, A-Z lower-cased), told apart by 64-bit
hashes. Three passes, all over the whole corpus:

1. Counts: every block of documents gives its distinct words with their counts as
   rows of a table, and Spark adds them up by word. The table of all words grows
   with the corpus and stays distributed. The HEAD most frequent words, and TAILS
   sets of all others (by hash), are the leaves of a binary tree, split at equal
   mass, so that frequent words have short paths.
2. Training: every task trains the network on all tokens of its share, in numpy,
   from one start; the networks are averaged, weighted by their tokens. From the
   SIDE words before and after a token, with the token itself masked, the network
   predicts which way its path turns at every node: a softmax over all leaves,
   word by word.
3. Scoring: a frequent word's probability is its path's. A rarer word's is its
   set's, times its share of the set by the corpus counts, less what its own
   document holds of it. A document's score is the sum of log-probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.common import discard, map_arrow, materialize, utf8_buffer
from lexquarry.llm.near_dedup import _BLANK, _TO_LOWER
from lexquarry.llm.pieces import slice_hashes

#: Words that are leaves of their own, and leaves of all other words. As input, other words are told apart by as many buckets.
HEAD, TAILS = 16_384, 256
HIDDEN = 10
SIDE = 2
BATCH = 2048
RATE = 0.1
#: Occurrences that every word of a tail leaf has besides those counted.
SMOOTH = 0.5
#: Values of the averaged network that travel as one row.
CHUNK = 8192
#: Text bytes of one block of documents.
GROUP_BYTES = 16 << 20
#: Words of a block whose distinct ones are found at once.
WORDS_AT_ONCE = 3_000_000


def tokens(data: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and where each text's words start (and the end)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(ptr), np.int64)
    solid = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ptr] = True
    begins, finishes = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    finishes[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return slice_hashes(_TO_LOWER[data], starts, ends), np.searchsorted(starts, ptr)


def signed(words: np.ndarray) -> np.ndarray:
    return words.view(np.int64)


# Vocabulary and tree ----------------------------------------------------------


class Vocabulary:
    """Leaves of words, and each leaf's path: nodes, and turns (+1 or -1).

    head: hashes of the frequent words; mass: occurrences of each of them, then of
    the tail leaves; types: different words of each tail leaf.
    """

    def __init__(self, head: np.ndarray, mass: np.ndarray, types: np.ndarray):
        order = np.argsort(head)
        self.words, self.leaf_of = head[order], order.astype(np.int32)
        self.n_head, self.tails = len(head), len(types)
        self.leaves = self.n_head + self.tails
        self.tail_mass, self.tail_types = mass[self.n_head :].astype(float), types.astype(float)
        self._grow(np.maximum(mass, 0.5))

    def _grow(self, mass: np.ndarray) -> None:
        by = np.argsort(-mass, kind="stable")
        upto = np.concatenate([[0.0], np.cumsum(mass[by])])
        paths: list[list[tuple[int, int]]] = [[] for _ in range(len(by))]
        stack, nodes, prior = [(0, len(by), [])], 0, []
        while stack:
            a, b, path = stack.pop()
            if b - a == 1:
                paths[by[a]] = path
                continue
            cut = int(np.searchsorted(upto, (upto[a] + upto[b]) / 2))
            cut = min(b - 1, max(a + 1, cut))
            node, nodes = nodes, nodes + 1
            prior.append(np.log((upto[cut] - upto[a]) / (upto[b] - upto[cut])))
            stack += [(a, cut, [*path, (node, 1)]), (cut, b, [*path, (node, -1)])]
        self.nodes, self.prior = nodes, np.array(prior, np.float32)  # log odds of each node's turns without any context
        self.depth = np.array([len(p) for p in paths], np.int64)
        self.first = np.cumsum(self.depth) - self.depth
        self.path = np.array([n for p in paths for n, _ in p], np.int32)
        self.turn = np.array([t for p in paths for _, t in p], np.float32)

    def place(self, words: np.ndarray) -> np.ndarray:
        """Leaf of every word."""
        out = (self.n_head + (words >> np.uint64(40)).astype(np.int64) % self.tails).astype(np.int64)
        if self.n_head:
            at = np.minimum(np.searchsorted(self.words, words), self.n_head - 1)
            hit = self.words[at] == words
            out[hit] = self.leaf_of[at[hit]]
        return out


def contexts(leaves: np.ndarray, ptr: np.ndarray, outside: int) -> np.ndarray:
    """(words, 2 * SIDE): leaves of the words around each word; ``outside`` beyond a text's ends."""
    n = len(leaves)
    doc_end = np.repeat(ptr[1:], np.diff(ptr))
    doc_start = np.repeat(ptr[:-1], np.diff(ptr))
    at = np.arange(n)
    out = np.empty((n, 2 * SIDE), np.int64)
    for j, shift in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        other = at + shift
        inside = (other >= doc_start) & (other < doc_end)
        out[:, j] = np.where(inside, leaves[np.clip(other, 0, max(0, n - 1))], outside)
    return out


# Network ----------------------------------------------------------------------


def sums_by(keys: np.ndarray, columns: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys under ``size``, and for each of them the sums of all columns, given as rows; a row a key comes out."""
    at = np.flatnonzero(np.bincount(keys, minlength=size))
    return at, np.stack([np.bincount(keys, c, size)[at] for c in columns], 1).astype(np.float32)


class Window:
    """tanh layer over the embeddings of the words around, and a vector for every node of the tree."""

    def __init__(self, vocabulary: Vocabulary, values: np.ndarray | None = None):
        self.vocabulary = vocabulary
        self.shapes = {"e": (vocabulary.leaves + 1, HIDDEN), "s": (2 * SIDE, HIDDEN), "h": (HIDDEN,), "w": (HIDDEN, vocabulary.nodes), "b": (vocabulary.nodes,)}
        self.p: dict[str, np.ndarray] = {}
        if values is None:
            rng = np.random.default_rng(17)
            values = np.concatenate([rng.normal(0, 0.3, int(np.prod(s))) if k != "s" else np.ones(int(np.prod(s))) for k, s in self.shapes.items()])
            values[-vocabulary.nodes * (HIDDEN + 1) :] = 0  # at first the words around change nothing
            values[-vocabulary.nodes :] = vocabulary.prior
        at = 0
        for k, s in self.shapes.items():
            n = int(np.prod(s))
            self.p[k] = values[at : at + n].reshape(s).astype(np.float32)
            at += n
        self.squares: dict[str, np.ndarray] = {}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].reshape(-1) for k in self.shapes])

    def hidden(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inputs = np.take(self.p["e"], context, axis=0)
        out = np.einsum("njd,jd->nd", inputs, self.p["s"])
        out += self.p["h"]
        return inputs, np.tanh(out, out)

    def turns(self, leaves: np.ndarray, hidden: np.ndarray):
        """Of all nodes on the leaves' paths: the word each belongs to, the node, both vectors (as columns), the turn and its score."""
        v = self.vocabulary
        depth = v.depth[leaves]
        word = np.repeat(np.arange(len(leaves)), depth)
        spot = np.arange(len(word)) + np.repeat(v.first[leaves] - (np.cumsum(depth) - depth), depth)
        node, turn = np.take(v.path, spot), np.take(v.turn, spot)
        said, vector = np.take(np.ascontiguousarray(hidden.T), word, axis=1), np.take(self.p["w"], node, axis=1)
        score = np.einsum("dn,dn->n", said, vector)
        score += np.take(self.p["b"], node)
        return word, node, said, vector, turn, score * turn

    def by_word(self, leaves: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Sums of columns over the nodes of each word's path, which stand together; no path is empty unless there is but one leaf."""
        depth = self.vocabulary.depth[leaves]
        if not depth.all():
            return np.zeros((*columns.shape[:-1], len(leaves)), columns.dtype)
        return np.add.reduceat(columns, np.cumsum(depth) - depth, axis=-1)

    def log_probabilities(self, leaves: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Of every word's leaf, given the leaves around it."""
        out = np.zeros(len(leaves))
        for i in range(0, len(leaves), BATCH):
            own = leaves[i : i + BATCH]
            _, hidden = self.hidden(context[i : i + BATCH])
            word, *_, score = self.turns(own, hidden)
            out[i : i + BATCH] = -np.bincount(word, np.log(1 + np.exp(-np.maximum(score, -80))), len(own))
        return out

    def _step(self, name: str, at, grad: np.ndarray) -> None:
        """Adagrad, with one rate for each vector (``w`` holds them as columns)."""
        spot = at[1] if name == "w" else at
        if name not in self.squares:
            self.squares[name] = np.full(self.p[name].shape[-1 if name == "w" else 0], 1e-6, np.float32)
        square = self.squares[name]
        square[spot] += (grad * grad).mean(1) if grad.ndim > 1 else grad * grad
        rate = RATE / np.sqrt(square[spot])
        step = grad * (rate[:, None] if grad.ndim > 1 else rate)
        self.p[name][at] -= step.T if name == "w" else step

    def learn(self, leaves: np.ndarray, context: np.ndarray) -> None:
        """One pass over the words, in batches of neighbouring words."""
        for i in range(0, len(leaves), BATCH):
            own, around = leaves[i : i + BATCH], context[i : i + BATCH]
            inputs, hidden = self.hidden(around)
            word, node, said, vector, turn, score = self.turns(own, hidden)
            pull = turn * (-1 / (1 + np.exp(score)) / len(own)).astype(np.float32)  # the loss's slope at each node's score
            vector *= pull
            said *= pull
            back = self.by_word(own, vector).T
            at, grad = sums_by(node, [*said, pull], self.vocabulary.nodes)
            self._step("w", (slice(None), at), grad[:, :-1])
            self._step("b", at, grad[:, -1])
            back *= 1 - hidden * hidden
            self._step("h", slice(None), back.sum(0))
            to = (back[:, None, :] * self.p["s"]).reshape(-1, HIDDEN)
            self._step("s", slice(None), np.einsum("njd,nd->jd", inputs, back))
            at, grad = sums_by(around.reshape(-1), np.ascontiguousarray(to.T), len(self.p["e"]))
            self._step("e", at, grad)


# Passes -----------------------------------------------------------------------


def grouped(docs: DataFrame) -> DataFrame:
    """``docs(id, text)`` written with the block of documents that each row belongs to."""

    def run(batches):
        from pyspark import TaskContext

        first, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            if size > GROUP_BYTES:
                first, size = first + 1, 0
            size += batch.nbytes
            yield pa.RecordBatch.from_arrays([pa.array([first] * len(batch), pa.int64()), *batch.columns], ["block", "id", "text"])

    return materialize(map_arrow(docs, run, f"block long, id {docs.schema['id'].dataType.simpleString()}, text string"), "lm-docs")


def block_words(docs: DataFrame) -> DataFrame:
    """``(block, word, n)``: distinct words of a block's documents with their counts (in several rows where a block is long or cut)."""

    def run(batches):
        held: list[np.ndarray] = []
        at = None

        def flush():
            word, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(word), at)), pa.array(signed(word)), pa.array(n.astype(np.int32))], ["block", "word", "n"])

        for batch in batches:
            block = np.asarray(batch.column(0))
            words, ptr = tokens(*utf8_buffer(batch.column(1)))
            cut = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(block)]):
                if held and (block[a] != at or sum(map(len, held)) > WORDS_AT_ONCE):
                    yield flush()
                    held.clear()
                at = block[a]
                held.append(words[ptr[a] : ptr[b]])
        if held:
            yield flush()

    return map_arrow(docs.select("block", "text"), run, "block long, word long, n int")


class Model:
    """The counts of all words as a table ``(word, total)``, the vocabulary, and the network once it is trained."""

    def __init__(self, totals: DataFrame, vocabulary: Vocabulary, network: Window | None = None):
        self.totals, self.vocabulary, self.network = totals, vocabulary, network


def count(words: DataFrame) -> Model:
    """The vocabulary of ``words(block, word, n)``: its head and one row a tail leaf come to the driver."""
    totals = materialize(words.groupBy("word").agg(F.sum("n").alias("total")), "lm-totals")
    # Few words have the counts of frequent ones: with the least count that HEAD words reach, only those are sorted.
    counts = totals.groupBy("total").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("total")).collect()  # about sqrt(2 N) rows for N words
    upto = np.cumsum([r["words"] for r in counts])
    least = counts[min(len(counts) - 1, int(np.searchsorted(upto, HEAD)))]["total"] if counts else 0
    head = totals.where(F.col("total") >= least).orderBy(F.desc("total"), "word").limit(HEAD).collect()
    leaf = F.pmod(F.shiftrightunsigned("word", 40), F.lit(TAILS)).alias("leaf")
    sums = {r["leaf"]: (r["mass"], r["types"]) for r in totals.groupBy(leaf).agg(F.sum("total").alias("mass"), F.count(F.lit(1)).alias("types")).collect()}
    mass, types = (np.array([sums.get(i, (0, 0))[j] for i in range(TAILS)], np.int64) for j in (0, 1))
    hashes, n = np.array([r["word"] for r in head], np.int64), np.array([r["total"] for r in head], np.int64)
    own = ((hashes.view(np.uint64) >> np.uint64(40)) % np.uint64(TAILS)).astype(np.int64)
    mass -= np.bincount(own, n, TAILS).astype(np.int64)
    types -= np.bincount(own, minlength=TAILS)
    return Model(totals, Vocabulary(hashes.view(np.uint64), np.concatenate([n, mass]), types))


def train(docs: DataFrame, vocabulary: Vocabulary) -> Window:
    """The average of the networks that the tasks trained on the tokens of ``docs(text)``."""

    def run(batches):
        network, seen = Window(vocabulary), 0
        for batch in batches:
            words, ptr = tokens(*utf8_buffer(batch.column(0)))
            leaves = vocabulary.place(words)
            network.learn(leaves, contexts(leaves, ptr, vocabulary.leaves))
            seen += len(words)
        if seen:
            flat = network.flat()
            chunks = [flat[i : i + CHUNK] for i in range(0, len(flat), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array([seen] * len(chunks), pa.int64()), pa.array([c.tobytes() for c in chunks], pa.binary())], ["chunk", "seen", "part"])

    def add(pdf):
        seen = pdf["seen"].to_numpy(float)
        total = np.zeros(len(pdf["part"].iloc[0]) // 4)
        for part, share in zip(pdf["part"], seen / seen.sum()):
            total += share * np.frombuffer(part, np.float32)
        return pdf.iloc[:1].assign(seen=int(seen.sum()), part=[total.astype(np.float32).tobytes()])

    trained = materialize(map_arrow(docs.select("text"), run, "chunk int, seen long, part binary"), "networks")
    # In two steps, so that no task adds up the chunks of very many networks.
    kind = "chunk int, seen long, part binary, team int"
    teams = trained.withColumn("team", F.pmod(F.xxhash64("part"), F.lit(64)).cast("int"))
    some = teams.groupBy("chunk", "team").applyInPandas(lambda pdf: add(pdf), kind)
    means = some.groupBy("chunk").applyInPandas(lambda pdf: add(pdf), kind).orderBy("chunk").collect()  # one network
    discard(trained)
    return Window(vocabulary, np.concatenate([np.frombuffer(r["part"], np.float32) for r in means]) if means else None)


def log_probabilities(network: Window, words: np.ndarray, ptr: np.ndarray, known: np.ndarray, total: np.ndarray, own_counts: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of every word, and whether no other document holds it.

    known, total: rarer words, ascending, and their counts in the corpus. own_counts:
    the texts are of the corpus, so their own occurrences are taken off.
    """
    vocabulary = network.vocabulary
    leaves = vocabulary.place(words)
    out = network.log_probabilities(leaves, contexts(leaves, ptr, vocabulary.leaves))
    rare = np.flatnonzero(leaves >= vocabulary.n_head)
    alone = np.zeros(len(words), bool)
    if len(rare):
        word = words[rare]
        at = np.minimum(np.searchsorted(known, word), max(0, len(known) - 1))
        n = np.where(known[at] == word, total[at], 0).astype(float) if len(known) else np.zeros(len(rare))
        if own_counts:
            doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))[rare]
            order = np.lexsort((word, doc))
            first = np.append(True, (word[order][1:] != word[order][:-1]) | (doc[order][1:] != doc[order][:-1]))
            run = np.cumsum(first) - 1
            held = np.empty(len(rare))
            held[order] = np.bincount(run)[run]
            n = n - held
        else:
            held = np.zeros(len(rare))
        alone[rare] = n <= 0
        tail = leaves[rare] - vocabulary.n_head
        mass = np.maximum(vocabulary.tail_mass[tail] - held, 0) + SMOOTH * (vocabulary.tail_types[tail] + 1)
        out[rare] += np.log((np.maximum(n, 0) + SMOOTH) / mass)
    return out, alone


def score_blocks(docs: DataFrame, counted: DataFrame, network: Window, own_counts: bool) -> DataFrame:
    """``(id, n_tokens, n_alone, sum_logp, mean_logp)`` of ``docs(block, id, text)``; counted: ``(block, word, total)`` of their rarer words."""
    id_kind = docs.schema["id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known = np.asarray(right["word"]).astype(np.int64).view(np.uint64)
        order = np.argsort(known)
        known, total = known[order], np.asarray(right["total"])[order]
        n_tokens, n_alone, sums = [], [], []
        for chunk in short_chunks(left):
            words, ptr = tokens(*utf8_buffer(chunk))
            logp, alone = log_probabilities(network, words, ptr, known, total, own_counts)
            for out, x in ((sums, logp), (n_alone, alone)):
                upto = np.concatenate([[0], np.cumsum(x)])
                out.append(upto[ptr[1:]] - upto[ptr[:-1]])
            n_tokens.append(np.diff(ptr))
        n = np.concatenate([np.zeros(0, np.int64), *n_tokens])
        s = np.concatenate([np.zeros(0), *sums])
        alone = np.concatenate([np.zeros(0, np.int64), *n_alone]).astype(np.int64)
        return pa.table([left["id"], pa.array(n, pa.int64()), pa.array(alone, pa.int64()), pa.array(s), pa.array(s / np.maximum(n, 1), mask=n == 0)], names=["id", "n_tokens", "n_alone", "sum_logp", "mean_logp"])

    return docs.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(run, f"id {id_kind}, n_tokens long, n_alone long, sum_logp double, mean_logp double")


def short_chunks(table: pa.Table):
    """The text column of a block in slices of bounded size."""
    from lexquarry.llm.common import short_batches

    for batch in short_batches(iter(table.select(["text"]).to_batches())):
        yield batch.column(0)


def rarer(words: DataFrame, model: Model) -> DataFrame:
    """``(block, word, total)`` of the words that are no leaves of their own; frequent ones go before the join, so no word has many rows. A long block's words may come twice."""
    spark = words.sparkSession
    head = spark.createDataFrame([(int(w),) for w in signed(model.vocabulary.words)], "word long")  # at most HEAD rows
    own = words.select("block", "word").join(F.broadcast(head), "word", "left_anti")
    return own.join(model.totals, "word").select("block", "word", "total")


def fit(df: DataFrame, text_col: str = "text") -> Model:
    """Counts of all words of all texts, and the network trained on them."""
    docs = grouped(df.select(F.lit(None).cast("long").alias("id"), F.col(text_col).alias("text")))
    model = count(block_words(docs))
    model.network = train(docs, model.vocabulary)
    discard(docs)
    return model


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score_blocks`` of texts that need not be of the corpus: ``(id, n_tokens, n_alone, sum_logp, mean_logp)``."""
    docs = grouped(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return score_blocks(docs, rarer(block_words(docs), model), model.network, False).withColumnRenamed("id", id_col)


def pseudo_likelihood(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on all texts of ``df`` and score each of them: ``(id, n_tokens, n_alone, sum_logp, mean_logp)``.

    n_alone counts the words that no other document holds. Null and empty texts,
    and texts of white space, have no words: sum_logp 0, mean_logp null. Repeated
    rows count and are scored as often as they occur. Only the two named columns
    are read. An empty table gives no rows.
    """
    docs = grouped(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    words = materialize(block_words(docs), "lm-words")
    model = count(words)
    network = train(docs, model.vocabulary)
    return score_blocks(docs, rarer(words, model), network, True).withColumnRenamed("id", id_col)
