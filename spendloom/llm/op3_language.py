"""Language identification of code-switched text by a linear-chain conditional random field.

Words are labelled with languages. A word's features are its affixes, its byte n-grams and
its entry in a lexicon of training words; transitions between the labels of neighbouring
words are learned with them. Forward-backward gives every word's distribution over
languages, and their mean over a text gives its language and score. Training sequences are
spliced from spans of texts in different languages, so the model learns how often text
switches. It is fitted on a bounded sample and predicts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendloom.llm import tables
from spendloom.llm.textblock import Words, blocks, hand_back, mix, span_hashes, tidy

UNKNOWN = "und"
#: The fit sees at most so many texts a language, of at most so many bytes each.
SAMPLE_TEXTS, SAMPLE_BYTES = 300, 200_000
#: Bytes of all sampled texts together, which the driver holds.
SAMPLE_TOTAL = 64 << 20
#: Of a column with more labels than these the commonest are learned; the fit is held on the driver.
SAMPLE_LABELS = 200
FEATURE_BITS = 18
AFFIXES, NGRAMS = (1, 2, 3, 4), (1, 2, 3)
STEPS, BATCH, SEQUENCE, RATE, DECAY = 260, 48, 64, 0.08, 1e-4
CHUNK = 64

_U = np.uint64
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # features x languages
    lexicon: np.ndarray  # sorted word hashes; their weights follow those of the hashed features
    transitions: np.ndarray


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) pairs, ordered by word within each kind of feature."""
    words, found = np.arange(len(starts), dtype=np.int32), []

    def add(who: np.ndarray, lo: np.ndarray, hi: np.ndarray, tag: int) -> None:
        found.append((who, (mix(span_hashes(data, lo, hi) ^ _U(tag)) >> _U(64 - FEATURE_BITS)).astype(np.int32)))

    size = ends - starts
    for k in AFFIXES:
        who = words[size >= k]
        add(who, starts[who], starts[who] + k, 0x100 + k)
        add(who, ends[who] - k, ends[who], 0x200 + k)
    for k in NGRAMS:
        many = np.maximum(size - k + 1, 0)
        who = np.repeat(words, many)
        lo = starts[who] + np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
        add(who, lo, lo + k, 0x300 + k)
    if len(lexicon):
        whole = span_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(lexicon, whole), len(lexicon) - 1)
        there = lexicon[at] == whole
        found.append((words[there], (at[there] + (1 << FEATURE_BITS)).astype(np.int32)))
    who, what = (np.concatenate(x) for x in zip(*found, strict=True))
    return who, what


def _gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the spans alone, one behind the other, and where each begins and ends there."""
    size = ends - starts
    hi = np.cumsum(size)
    lo = hi - size
    return data[np.repeat(starts - lo, size) + np.arange(size.sum())], lo, hi


def emissions(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Summed feature weights of every word, each distinct word computed once."""
    if not len(starts):
        return np.zeros((0, len(model.languages)))
    _, first, of = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    who, what = features(*_gathered(data, starts[first], ends[first]), model.lexicon)
    per = np.stack([np.bincount(who, model.weights[what, k], len(first)) for k in range(len(model.languages))], axis=1)
    return per[of]


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(axis=-1, keepdims=True), 1e-300)


def marginals(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Forward-backward over the words of many texts at once: each word's distribution over labels.

    Texts are cut into chunks. The products of all chunks' transfer matrices are computed side
    by side, chained per text, and the chunks are then filled in side by side again.
    """
    n, labels = scores.shape
    likely = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-30
    step = np.exp(transitions - transitions.max())
    counts = np.diff(first)
    chunks = -(-counts // CHUNK)
    head = np.r_[0, np.cumsum(chunks)]
    doc = np.repeat(np.arange(len(counts)), chunks)
    begin = first[doc] + (np.arange(head[-1]) - head[doc]) * CHUNK
    size = np.minimum(first[doc + 1] - begin, CHUNK)

    product = np.broadcast_to(np.eye(labels), (len(begin), labels, labels)).copy()
    for t in range(CHUNK):
        on = np.flatnonzero(size > t)
        if not len(on):
            break
        x = (product[on] @ step) * likely[begin[on] + t][:, None, :]
        product[on] = x / x.max(axis=(1, 2), keepdims=True)
    before, after = np.full((len(begin), labels), 1.0 / labels), np.full((len(begin), labels), 1.0 / labels)
    for j in range(1, int(chunks.max(initial=0))):
        on = head[:-1][chunks > j] + j
        before[on] = _scaled(np.einsum("ci,cij->cj", before[on - 1], product[on - 1]))
        on = head[1:][chunks > j] - 1 - j
        after[on] = _scaled(np.einsum("cij,cj->ci", product[on + 1], after[on + 1]))
    ahead, behind = np.empty((n, labels)), np.empty((n, labels))
    for t in range(CHUNK):
        on = np.flatnonzero(size > t)
        before[on] = ahead[begin[on] + t] = _scaled((before[on] @ step) * likely[begin[on] + t])
    for t in reversed(range(CHUNK)):
        on = np.flatnonzero(size > t)
        behind[begin[on] + t] = after[on]
        after[on] = _scaled((likely[begin[on] + t] * after[on]) @ step.T)
    return _scaled(ahead * behind)


def _learn(words: list[np.ndarray], languages: list[str], label: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Model:
    """Stochastic gradient ascent (AdaGrad) on the log-likelihood of spliced sequences.

    words[i]: which distinct words text i consists of; label[i]: its language.
    """
    random, many = np.random.default_rng(7), len(languages)
    hashes = span_hashes(data, starts, ends)
    texts_with = np.bincount(np.concatenate([np.unique(w) for w in words]), minlength=len(starts))
    lexicon = np.sort(hashes[texts_with > 1])
    who, what = features(data, starts, ends, lexicon)
    order = np.argsort(who, kind="stable")
    who, what = who[order], what[order]
    head = np.searchsorted(who, np.arange(len(starts) + 1))
    weights, square = np.zeros(((1 << FEATURE_BITS) + len(lexicon), many)), np.full(((1 << FEATURE_BITS) + len(lexicon), many), 1e-3)
    transitions, t_square = np.zeros((many, many)), np.full((many, many), 1e-3)
    by_label = [np.flatnonzero(label == k) for k in range(many)]
    for _ in range(STEPS):
        tokens, truth = np.zeros((BATCH, SEQUENCE), np.int64), np.zeros((BATCH, SEQUENCE), np.int64)
        for b in range(BATCH):
            at = 0
            while at < SEQUENCE:
                k = int(random.integers(many))
                own = words[by_label[k][random.integers(len(by_label[k]))]]
                span = int(min(random.integers(4, 2 * SEQUENCE), len(own), SEQUENCE - at))
                lo = int(random.integers(len(own) - span + 1))
                tokens[b, at : at + span] = own[lo : lo + span]
                truth[b, at : at + span] = k
                at += span
        flat = tokens.ravel()
        sizes = (head[flat + 1] - head[flat]).astype(np.int64)
        token = np.repeat(np.arange(len(flat)), sizes)
        feature = what[np.repeat(head[flat] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        scores = np.stack([np.bincount(token, weights[feature, k], len(flat)) for k in range(many)], axis=1)
        first = np.arange(BATCH + 1) * SEQUENCE
        step = np.exp(transitions - transitions.max())
        p = marginals(scores, first, transitions)
        # Pair expectations from the same forward-backward, for the transitions' gradient.
        likely = np.exp(scores - scores.max(axis=1, keepdims=True)).reshape(BATCH, SEQUENCE, many)
        ahead = np.full((BATCH, many), 1.0 / many)
        fore = []
        for t in range(SEQUENCE):
            fore.append(ahead := _scaled((ahead @ step) * likely[:, t]))
        expected, behind = np.zeros((many, many)), np.ones((BATCH, many))
        for t in reversed(range(1, SEQUENCE)):
            pair = fore[t - 1][:, :, None] * step[None] * (likely[:, t] * behind)[:, None, :]
            expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            behind = _scaled((likely[:, t] * behind) @ step.T)
        seen = np.zeros((many, many))
        np.add.at(seen, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)
        gradient = -p
        gradient[np.arange(len(flat)), truth.ravel()] += 1
        used, at = np.unique(feature, return_inverse=True)
        push = np.stack([np.bincount(at, gradient[token, k], len(used)) for k in range(many)], axis=1) / BATCH - DECAY * weights[used]
        square[used] += push**2
        weights[used] += RATE * push / np.sqrt(square[used])
        push = (seen - expected) / BATCH - DECAY * transitions
        t_square += push**2
        transitions += RATE * push / np.sqrt(t_square)
    return Model(languages, weights.astype(np.float32), lexicon, transitions)


def _words(block) -> Words:
    words = block.words(LETTERS)
    words.data = _FOLD[words.data]
    return words


def _smallest(rows: DataFrame, texts: int, most: int) -> DataFrame:
    """(label, cut): the hash of each label's last text of `texts`, by distinct hashes, and of `most` bytes; tasks keep so many only."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            hashes, sizes, names = batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(0).dictionary_encode()
            codes = names.indices.to_numpy()
            for k, label in enumerate(names.dictionary.to_pylist()):
                known = least.get(label, (hashes[:0], sizes[:0]))
                found, first = np.unique(np.r_[known[0], hashes[codes == k]], return_index=True)
                least[label] = found[:texts], np.r_[known[1], sizes[codes == k]][first][:texts]
        for label, (found, size) in least.items():
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(found), pa.string()), pa.array(found, pa.int64()), pa.array(size, pa.int64())], ["label", "h", "size"])

    each = rows.select("label", "h", "size").mapInArrow(run, "label string, h long, size long").distinct()
    # As many rows as there are labels times texts; a label's first text is taken whatever its size.
    order = Window.partitionBy("label").orderBy("h", "size")
    each = each.withColumns({"k": F.row_number().over(order), "sum": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return each.where((F.col("k") == 1) | ((F.col("k") <= texts) & (F.col("sum") <= most))).groupBy("label").agg(F.max("h").alias("cut"))


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang", texts: int = SAMPLE_TEXTS, labels: int = SAMPLE_LABELS) -> Model:
    """Fit on a sample of labelled rows: the `texts` of each label with the smallest hash of id and text.

    Rows without a label, a text or a letter teach nothing, those of one id and text count once,
    and ids may be null or repeat. Of more than `labels` labels the commonest are learned.
    All texts together have at most SAMPLE_TOTAL bytes, shared evenly by the labels.
    Without any, the model is empty.
    """
    labelled = docs.select(F.col(text_column).alias("text"), F.col(label_column).cast("string").alias("label"), F.xxhash64(id_column, text_column).alias("h"), F.octet_length(text_column).cast("long").alias("size"))
    labelled = labelled.where(F.col("text").isNotNull() & F.col("label").isNotNull() & (F.col("size") <= SAMPLE_BYTES))
    common = [r["label"] for r in labelled.groupBy("label").count().orderBy(F.desc("count"), "label").limit(labels).collect()]
    if not common:
        return Model([], np.zeros((0, 0), np.float32), np.zeros(0, _U), np.zeros((0, 0)))
    cuts = _smallest(labelled.where(F.col("label").isin(common)), texts, SAMPLE_TOTAL // len(common)).collect()
    cut = F.create_map(*(x for r in cuts for x in (F.lit(r["label"]), F.lit(r["cut"]))))
    chosen = labelled.where(F.col("h") <= cut[F.col("label")]).groupBy("label", "h").agg(F.min("text").alias("text"))
    sample = chosen.toPandas().sort_values(["label", "h"])
    own, known = [], []  # word hashes of every text; hashes and bytes of the distinct words of every block
    for block in blocks(pa.array(sample["text"], pa.string())):
        words = _words(block)
        hashes = words.hashes()
        own += np.split(hashes, words.first[1:-1])
        distinct, first = np.unique(hashes, return_index=True)
        data, lo, hi = _gathered(words.data, words.starts[first], words.ends[first])
        known.append((distinct, hi - lo, data))
    has = [i for i, x in enumerate(own) if len(x)]
    if not has:
        return Model([], np.zeros((0, 0), np.float32), np.zeros(0, _U), np.zeros((0, 0)))
    hashes, sizes, data = (np.concatenate(x) for x in zip(*known, strict=True))
    distinct, first = np.unique(hashes, return_index=True)
    ends = np.cumsum(sizes)[first]
    languages = sorted(sample["label"].iloc[has].unique())
    label = np.array([languages.index(x) for x in sample["label"].iloc[has]])
    return _learn([np.searchsorted(distinct, own[i]) for i in has], languages, label, data, ends - sizes[first], ends)


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """lang_pred, score and switches (how often the likeliest language changes) of every whole text.

    `und` and 0 for a null text, one without a letter, or an empty model. keep: further
    columns to carry; repeated rows are each predicted, ids may be null, texts of any length
    are read whole, of equal scores the first language by name counts; an empty table gives an
    empty result.
    """
    names = [id_column, *(keep or [])]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            labels, scores, switches = [], [], []
            column = batch.column(len(names))
            for block in blocks(column):
                words = _words(block)
                # Only letters count: bytes over 0x7F may be signs, so rare texts without a-z are looked at.
                plain = np.r_[0, np.cumsum((words.data >= 0x61) & (words.data <= 0x7A))]
                letters = plain[block.bounds[1:]] > plain[block.bounds[:-1]]
                for i in np.flatnonzero(~letters & (words.counts() > 0)):
                    letters[i] = any(c.isalpha() for c in column[block.lo + int(i)].as_py())
                best, score, turns = np.full(block.n, len(model.languages)), np.zeros(block.n), np.zeros(block.n, np.int64)
                there = letters & (words.counts() > 0)
                if model.languages and there.any():
                    p = marginals(emissions(model, words.data, words.starts, words.ends), words.first, model.transitions)
                    total = np.zeros((len(p) + 1, p.shape[1]))
                    np.cumsum(p, axis=0, out=total[1:])
                    mean = (total[words.first[1:]] - total[words.first[:-1]]) / np.maximum(words.counts(), 1)[:, None]
                    best = np.where(there, mean.argmax(axis=1), best)
                    score = np.where(there, np.clip(mean.max(axis=1), 0, 1), 0)
                    top = p.argmax(axis=1)
                    change = np.r_[0, np.cumsum((top[1:] != top[:-1]) & (words.docs()[1:] == words.docs()[:-1])), 0]
                    turns = np.where(there, change[np.maximum(words.first[1:] - 1, 0)] - change[np.minimum(words.first[:-1], len(top))], 0)
                labels += known[best].tolist()
                scores.append(score)
                switches.append(turns)
            new = [pa.array(labels, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(np.concatenate(switches) if switches else [], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *new], [*names, "lang_pred", "score", "switches"])

    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("switches", T.LongType())]
    return docs.select(*names, text_column).mapInArrow(run, T.StructType([*(docs.schema[c] for c in names), *new]))


def held_out(id_column: str = "doc_id"):
    """Documents that no fit sees: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_on_kept(docs: DataFrame) -> Model:
    model = fit(docs.where(~held_out()))
    hand_back()
    return model


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    found = predict(docs, fit_on_kept(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "switches")
