"""Quality rules: counts over words and lines, and perplexity under a language model counted by Spark.

The model is a modified Kneser-Ney n-gram model over characters (``order`` of them, words lower-cased and parted by
one blank), one for each language, counted over every document. Words of this kind of corpus are nearly all rare, so a
model over words would know next to nothing of a text and its table would be as large as the corpus.
Scoring reads sorted hash arrays; a model too large to send out is joined instead.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from creaseline.llm.common import slices, texts

ORDER = 5
SEND_ROWS = 4_000_000  # n-grams of a model that is sent to the tasks: 16 bytes each
PART_ROWS = 500_000  # n-grams that pass through the driver at a time, or one language's if it has more
SYMBOLS = list(b"#*$%&|<>")
BLANKS = list(b" \t\n\v\f\r")
WINDOW = 8
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
PRIME = np.uint64(0x9E3779B97F4A7C15)


# Words and lines


def repeated_words(words: list[bytes], owner: np.ndarray, texts_in: int) -> np.ndarray:
    """For each text, how many of its words lie in a window of eight that the text holds at least twice.

    ``words`` are those of several texts one after the other, ``owner`` numbers their texts. Windows are met by a
    hash; only windows whose hash occurs twice are compared word by word.
    """
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros(texts_in, np.int64)
    own = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    hashes = owner[:n].astype(np.uint64) * PRIME
    for i in range(WINDOW):
        hashes = (hashes + own[i : n + i]) * PRIME
    ordered = np.sort(hashes)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(twice) == 0:
        return np.zeros(texts_in, np.int64)
    marks = np.zeros(1 << 20, bool)  # by the last bits, so that few are looked up
    marks[twice & np.uint64(0xFFFFF)] = True
    maybe = np.flatnonzero(marks[hashes & np.uint64(0xFFFFF)] & (owner[:n] == owner[WINDOW - 1 :]))
    group = np.minimum(np.searchsorted(twice, hashes[maybe]), len(twice) - 1)
    met = twice[group] == hashes[maybe]
    # those of one hash side by side, each compared with the first of them
    maybe, group = maybe[met], group[met]
    order = np.argsort(group, kind="stable")
    maybe, group = maybe[order], group[order]
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(maybe) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(heads, len(maybe)))
    first = np.repeat(maybe[heads], sizes)
    pairs = zip(maybe.tolist(), first.tolist(), strict=True)
    if all(words[a : a + WINDOW] == words[b : b + WINDOW] for a, b in pairs if a != b) and (owner[maybe] == owner[first]).all():
        starts = maybe[np.repeat(sizes > 1, sizes)]
    else:  # different windows of one hash
        seen = Counter(keys := [(owner[a], *words[a : a + WINDOW]) for a in maybe.tolist()])
        starts = maybe[[seen[k] > 1 for k in keys]]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return np.bincount(owner[np.cumsum(edge[:-1]) > 0], minlength=texts_in)


def text_stats(several: list[str]) -> list[np.ndarray]:
    """The columns of STATS for some texts. Words end at the six ASCII blanks and nowhere else."""
    every: list[bytes] = []
    counts = np.zeros((len(STATS), len(several)), np.int64)
    for i, text in enumerate(several):
        raw = text.encode()
        words = raw.split()  # of bytes: at ASCII blanks only
        every += words
        each = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
        counts[:4, i] = len(words), len(text) - each[BLANKS].sum(), each[SYMBOLS].sum(), len(lines) - len(set(lines))
    owner = np.repeat(np.arange(len(several)), counts[0])
    counts[4] = repeated_words(every, owner, len(several))
    return list(counts)


# Language model


def spelled(text: str) -> str:
    """What the model reads of a text; empty if it has no word."""
    words = text.lower().split()
    return f" {' '.join(words)} " if words else ""


def hashed(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of characters given column by column."""
    out = columns[0].astype(np.uint64) + np.uint64(1)
    for column in columns[1:]:
        out = out * PRIME + column + np.uint64(1)
    return (out ^ (out >> np.uint64(29))) * PRIME


def gram_hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """A hash of the ``order`` characters from each place on."""
    n = max(0, len(codes) - order + 1)
    return hashed([codes[i : n + i] for i in range(order)])


def distinct_grams(text: str, order: int) -> tuple[list[str], np.ndarray]:
    """The n-grams of a text and their counts, but for those with a zero character, which parts texts."""
    codes = code_points(text)
    n = len(codes) - order + 1
    if n <= 0:
        return [], np.zeros(0, np.int64)
    number = np.zeros(int(codes.max()) + 1, np.int32)
    number[codes] = 1
    alphabet = np.flatnonzero(number)
    number[alphabet] = np.arange(len(alphabet))
    ids = number[codes]
    del codes
    bits = max(1, int(len(alphabet) - 1).bit_length())
    if bits * order <= 63:
        packed = np.zeros(n, np.int64)
        for i in range(order):  # in place: these are the largest arrays of a task
            packed <<= bits
            packed |= ids[i : n + i]
        packed.sort()
        first = np.flatnonzero(np.append(True, packed[1:] != packed[:-1]))
        counts = np.diff(np.append(first, n))
        rows = np.stack([(packed[first] >> (bits * i)) & ((1 << bits) - 1) for i in reversed(range(order))], axis=1)
    else:  # very many different characters
        rows, counts = np.unique(np.stack([ids[i : n + i] for i in range(order)], axis=1), axis=0, return_counts=True)
    points = alphabet[rows]
    whole = (points != 0).all(axis=1)
    joined = points[whole].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    return [joined[i : i + order] for i in range(0, len(joined), order)], counts[whole]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang, gram, n`` over every text; each task folds its own n-grams before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=4 << 20):
            by_lang: dict[str, list[str]] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(spelled(text))
            for lang, own in by_lang.items():
                grams, n = distinct_grams("\0".join(t.replace("\0", " ") for t in own), order)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])

    langs = texts(docs, F.coalesce("lang", F.lit("")).alias("lang"))
    counted = langs.mapInArrow(run, "lang string, gram string, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(grams: DataFrame) -> DataFrame:
    """Discounts of counts 1, 2 and 3 or more for each language, from the counts of counts."""
    n = [F.sum(F.when(F.col("n") == i, 1).otherwise(0)).alias(f"n{i}") for i in range(1, 5)]
    y = F.try_divide(F.col("n1"), F.expr("n1 + 2 * n2"))
    raw = [F.lit(i) - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")) for i in (1, 2, 3)]
    # a corpus too small to have such counts takes three quarters of a count
    bounded = [F.least(F.greatest(F.coalesce(r, F.lit(0.75)), F.lit(0.05)), F.lit(float(i))) for i, r in enumerate(raw, 1)]
    return grams.groupBy("lang").agg(*n).select("lang", *[d.alias(f"d{i}") for i, d in enumerate(bounded, 1)])


def kneser_ney(counted: DataFrame, order: int, keep) -> DataFrame:
    """``lang, width, gram, logp, backoff, raw, before`` of all n-grams of 1 to ``order`` characters.

    ``backoff`` is the logarithm of the weight that the n-gram, as a context, leaves to the shorter ones. Counts of
    shorter n-grams are the numbers of characters seen before them; ``raw`` says how often the n-gram ends at a scored
    character and ``before`` how often it stands before one. ``keep`` cuts the lineage between the orders.
    """
    levels = {order: counted.withColumn("raw", F.col("n"))}
    for width in range(order - 1, 0, -1):
        longer = levels[width + 1]
        levels[width] = keep(longer.groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"), F.sum("raw").alias("raw")))
    model = None
    lower = None
    for width in range(1, order + 1):
        grams = levels[width].join(F.broadcast(_discounts(levels[width])), "lang")  # one row for each language
        grams = grams.withColumn("d", F.expr("least(n, case n when 1 then d1 when 2 then d2 else d3 end)"))
        grams = grams.withColumn("context", F.expr(f"substring(gram, 1, {width - 1})"))
        context = grams.groupBy("lang", "context").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("left"), F.count("*").alias("kinds"), F.sum("raw").alias("before"))
        rows = grams.join(context.drop("before"), ["lang", "context"])
        if width == 1:
            rows = rows.withColumn("below", 1 / (F.col("kinds") + 1))  # one more for what was never seen
        else:
            rows = rows.withColumn("suffix", F.expr("substring(gram, 2)")).join(lower, ["lang", "suffix"])
        level = keep(rows.select("lang", "gram", "raw", ((F.col("n") - F.col("d")) / F.col("total") + F.col("left") * F.col("below")).alias("p")))
        weights = context.select("lang", F.col("context").alias("gram"), F.log("left").alias("backoff"), "before")
        none = F.lit(None)
        known = level.select("lang", F.lit(width).alias("width"), "gram", F.log("p").alias("logp"), none.cast("double").alias("backoff"), "raw", none.cast("long").alias("before"))
        of_context = weights.select("lang", F.lit(width - 1).alias("width"), "gram", none.cast("double").alias("logp"), "backoff", none.cast("long").alias("raw"), "before")
        part = known.unionByName(of_context)
        model = part if model is None else model.unionByName(part)
        lower = level.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below"))
    # an n-gram's own row and its row as a context meet; the empty context carries the weight of the unseen
    return model.groupBy("lang", "width", "gram").agg(*[F.max(c).alias(c) for c in ("logp", "backoff", "raw", "before")])


class Scorer:
    """Sorted hash arrays of every order of one language."""

    def __init__(self, rows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], order: int):
        self.order = order
        empty = np.zeros(0)
        self.tables = {w: (np.zeros(0, np.uint64), empty, empty, empty, empty) for w in range(order + 1)}
        self.starts: dict[int, tuple[np.ndarray, np.uint64]] = {}
        self.unseen = 0.0
        for width, keys, logp, backoff, raw, before in rows:
            at = np.argsort(keys)
            keys = keys[at]
            # where the keys that begin with each run of bits start
            shift = 64 - max(1, len(keys).bit_length())
            starts = np.searchsorted(keys, np.arange(1 << (64 - shift), dtype=np.uint64) << np.uint64(shift)).astype(np.int32)
            self.tables[width] = keys, logp[at], np.nan_to_num(backoff[at]), raw[at], before[at]
            self.starts[width] = starts, np.uint64(shift)
            if width == 0:
                self.unseen = float(np.nan_to_num(backoff)[0])
        kinds = len(self.tables[1][0])
        self.unseen -= float(np.log(kinds + 1))
        self.met = np.zeros(max(len(t[0]) for t in self.tables.values()), np.int32)  # all zero between two uses

    def _find(self, width: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.tables[width][0]
        if len(keys) == 0:
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        starts, shift = self.starts[width]
        at = np.minimum(starts[hashes >> shift], len(keys) - 1)
        behind = np.flatnonzero(keys[at] < hashes)
        while len(behind):
            at[behind] += 1
            behind = behind[(at[behind] < len(keys) - 1) & (keys[np.minimum(at[behind], len(keys) - 1)] < hashes[behind])]
        at = np.minimum(at, len(keys) - 1)
        return at, keys[at] == hashes

    def _elsewhere(self, counts: np.ndarray, at: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Which hits count more often than this text alone has them, ``at`` being all its places that are still open.

        Places that a longer n-gram settled need not be counted: that n-gram is another text's, and so is its end.
        """
        own = at[hit]
        np.add.at(self.met, own, 1)
        out = hit.copy()
        out[hit] = counts[own] > self.met[own]
        self.met[own] = 0
        return out

    def logs(self, codes: np.ndarray, apart: bool = False, found: tuple | None = None) -> np.ndarray:
        """Logarithms of the probability of each character after its ``order - 1`` forerunners.

        ``apart`` takes n-grams and contexts that no other text holds as unseen; the text must be one of those counted.
        """
        n = max(0, len(codes) - self.order + 1)
        out, open_ = np.zeros(n), np.arange(n)
        for width in range(self.order, 0, -1):
            if len(open_) == 0:
                return out
            keys, logp, _, raw, _ = self.tables[width]
            if width == self.order and found:
                at, hit = found
            else:
                hashes = gram_hashes(codes, width)[self.order - width :]
                at, hit = self._find(width, hashes[open_])
            if apart:
                hit = self._elsewhere(raw, at, hit)
            out[open_[hit]] += logp[at[hit]]
            open_ = open_[~hit]
            if width > 1 and len(open_):
                _, _, backoff, _, before = self.tables[width - 1]
                contexts = gram_hashes(codes, width - 1)[self.order - width : self.order - width + n]
                at, hit = self._find(width - 1, contexts[open_])
                if apart:
                    hit = self._elsewhere(before, at, hit)
                out[open_[hit]] += backoff[at[hit]]
        out[open_] += self.unseen
        return out

    def losses(self, codes: np.ndarray) -> tuple[float, float]:
        """Minus the mean logarithm of a character's probability, with the text's own n-grams and apart from them.

        Each n-gram is looked up once. What other texts hold is known at all, so the places that are open apart
        hold those that are open otherwise (``mine``).
        """
        n = max(0, len(codes) - self.order + 1)
        whole, apart = np.zeros(n), np.zeros(n)
        open_, mine = np.arange(n), np.ones(n, bool)
        hashes = gram_hashes(codes, self.order)
        for width in range(self.order, 0, -1):
            if len(open_) == 0:
                break
            _, logp, _, raw, _ = self.tables[width]
            at, hit = self._find(width, hashes[self.order - width :][open_])
            own, other = hit & mine, self._elsewhere(raw, at, hit)
            whole[open_[own]] += logp[at[own]]
            apart[open_[other]] += logp[at[other]]
            stay = ~other
            open_, mine = open_[stay], (mine & ~hit)[stay]
            if width > 1 and len(open_):
                _, _, backoff, _, before = self.tables[width - 1]
                hashes = gram_hashes(codes, width - 1)  # of the contexts here, of the n-grams in the next round
                at, hit = self._find(width - 1, hashes[self.order - width :][open_])
                own, other = hit & mine, self._elsewhere(before, at, hit)
                whole[open_[own]] += backoff[at[own]]
                apart[open_[other]] += backoff[at[other]]
        whole[open_[mine]] += self.unseen
        apart[open_] += self.unseen
        return -float(whole.mean(dtype=np.float64)), -float(apart.mean(dtype=np.float64))


def _arrays(model: DataFrame) -> dict[str, list]:
    """The model as arrays; hashes are computed where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column("gram").to_pylist()
            keys = np.zeros(len(grams), np.uint64)
            widths = np.array(batch.column("width"))
            for width in set(widths.tolist()) - {0}:
                own = np.flatnonzero(widths == width)
                codes = code_points("".join(grams[i] for i in own.tolist())).reshape(len(own), -1)
                keys[own] = hashed([codes[:, i] for i in range(width)])
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("width"), pa.array(keys.view(np.int64)), *[batch.column(c) for c in names[3:]]], names)

    names = ["lang", "width", "key", "logp", "backoff", "raw", "before"]
    # no text is long enough for a count beyond 31 bits to matter
    counts = [F.least(F.coalesce(c, F.lit(0)), F.lit(2**31 - 1)).cast("int").alias(c) for c in names[5:]]
    slim = model.select("lang", "width", "gram", *[F.col(c).cast("float").alias(c) for c in names[3:5]], *counts)
    got = slim.mapInArrow(run, "lang string, width int, key long, logp float, backoff float, raw int, before int").toArrow()
    named = got["lang"].combine_chunks().dictionary_encode()
    langs, widths = named.indices.to_numpy(), got["width"].to_numpy()
    keys = got["key"].to_numpy().view(np.uint64)
    values = [got[c].to_numpy() for c in names[3:]]
    out: dict[str, list] = {}
    for number, lang in enumerate(named.dictionary.to_pylist()):
        out[lang] = []
        for width in np.unique(widths).tolist():
            own = (langs == number) & (widths == width)
            out[lang].append((width, keys[own], *[v[own] for v in values]))
    return out


def _sent(model: DataFrame, sizes: dict[str, int]) -> dict[str, Broadcast]:
    """The arrays of each language, broadcast in parts: the driver holds one part at a time and gives its memory back."""
    parts: list[list[str]] = []
    room = 0
    for lang in sorted(sizes):
        if not parts or sizes[lang] > room:
            parts.append([])
            room = PART_ROWS
        parts[-1].append(lang)
        room -= sizes[lang]
    out = {}
    for langs in parts:
        one = model.sparkSession.sparkContext.broadcast(_arrays(model.where(F.col("lang").isin(langs))))
        pa.default_memory_pool().release_unused()
        out |= dict.fromkeys(langs, one)
    return out


def score(docs: DataFrame, model: DataFrame, order: int, send_rows: int = SEND_ROWS, carry: bool = False) -> DataFrame:
    """The columns of STATS with ``doc_id``, ``lang`` and ``loss``: minus the mean logarithm of a character's probability.

    ``apart`` is the same with every n-gram that no other text of the model holds taken as unseen. Both are null for a text of fewer than ``order`` characters. Null texts count as empty, a null language is a
    language of its own; repeated rows give repeated rows. With ``carry`` there are ``text`` and ``record``, the row of
    ``docs`` but for its text.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    others = [docs[f"`{c.replace('`', '``')}`"] for c in docs.columns if c != "text"]
    record = [F.struct(*others).alias("record")] if carry else []
    sizes = {r.lang: r.n for r in model.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = sum(sizes.values()) <= send_rows
    sent = _sent(model, sizes) if whole else {}
    schema = f"doc_id {kind}, lang string, digest long, {', '.join(f'{c} long' for c in STATS)}, loss double, apart double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers: dict[str, Scorer] = {}
        for batch in slices(batches, size=2 << 20):
            several, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            losses: list[tuple[float | None, float | None]] = [(None, None)] * len(several)
            for i, lang in enumerate(langs if whole else []):
                own = spelled(several[i])
                if len(own) >= order:
                    if lang not in scorers:
                        scorers[lang] = Scorer(sent[lang].value[lang] if lang in sent else [], order)
                    losses[i] = scorers[lang].losses(code_points(own))
            stats = [pa.array(c) for c in text_stats(several)]
            known, more = ([batch.column(c) for c in names] for names in (("doc_id", "lang", "digest"), carried))
            yield pa.RecordBatch.from_arrays(
                [*known, *stats, *[pa.array(c, pa.float64()) for c in zip(*losses, strict=True)], *more], ["doc_id", "lang", "digest", *STATS, "loss", "apart", *carried]
            )

    carried = ["text", "record"] if carry else []
    digest = F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest")
    named = texts(docs, F.coalesce("lang", F.lit("")).alias("lang"), digest, *record)
    if carry:
        schema += f", text string, record {named.schema['record'].dataType.simpleString()}"
    named = named.select("doc_id", "lang", "digest", "text", *(["record"] if carry else []))
    scored = named.mapInArrow(run, schema)
    return (scored if whole else _joined(named, scored.drop("loss", "apart"), model, order)).drop("digest")


def _settled(rows: list[dict], kinds: int, order: int) -> tuple[float, float]:
    """Both losses of a text from its distinct n-grams; ``levels`` has the model's rows from the longest n-gram down."""
    out = []
    times = np.array([r["n"] for r in rows], np.int64)
    for apart in (False, True):
        logs, open_ = np.zeros(len(rows)), np.arange(len(rows))
        for level in range(2 * order):
            width, context = order - level // 2, level % 2
            own = [rows[i]["gram"][order - width : order - context] for i in open_.tolist()]
            met = [rows[i]["levels"][level] for i in open_.tolist()]
            known = np.array([m is not None and m["logp"] is not None for m in met], bool)
            if apart and level < 2 * order - 1:  # the empty context is everyone's
                sums: Counter = Counter()
                for gram, n in zip(own, times[open_].tolist(), strict=True):
                    sums[gram] += n
                known &= np.array([k and m["n"] > sums[g] for g, m, k in zip(own, met, known.tolist(), strict=True)], bool)
            logs[open_[known]] += [m["logp"] for m, k in zip(met, known.tolist(), strict=True) if k]
            if not context:
                open_ = open_[~known]
        logs[open_] -= np.log(kinds + 1)
        out.append(-float((logs * times).sum() / times.sum()))
    return out[0], out[1]


def _joined(named: DataFrame, stats: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """Losses through joins: distinct n-grams are resolved against the table, then summed for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=2 << 20):
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = spelled(text)
                grams: dict[str, int] = {}
                for at in range(len(own) - order + 1):
                    gram = own[at : at + order]
                    grams[gram] = grams.get(gram, 0) + 1
                if grams:
                    known = [batch.column(c).take(pa.array([i] * len(grams))) for c in ("doc_id", "lang", "digest")]
                    yield pa.RecordBatch.from_arrays([*known, pa.array(grams.keys(), pa.string()), pa.array(grams.values(), pa.int64())], ["doc_id", "lang", "digest", "gram", "n"])

    kind = named.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang string, digest long, gram string, n long"
    held = named.dropDuplicates(["doc_id", "lang", "digest"]).mapInArrow(run, schema)
    grams = held.select("lang", "gram").distinct()
    for width in range(order, 0, -1):
        tail = F.expr(f"substring(gram, {order - width + 1}, {width})")
        context = F.expr(f"substring(gram, {order - width + 1}, {width - 1})")
        of = model.where(F.col("width") == width).select("lang", F.col("gram").alias("tail"), F.struct("logp", F.col("raw").alias("n")).alias(f"own{width}"))
        over = model.where(F.col("width") == width - 1).select("lang", F.col("gram").alias("context"), F.struct(F.col("backoff").alias("logp"), F.col("before").alias("n")).alias(f"context{width}"))
        grams = grams.withColumn("tail", tail).join(of, ["lang", "tail"], "left").withColumn("context", context).join(over, ["lang", "context"], "left").drop("tail", "context")
    kinds = model.where("width = 1 and logp is not null").groupBy("lang").agg(F.count("*").alias("kinds"))
    levels = [f"{kind}{width}" for width in range(order, 0, -1) for kind in ("own", "context")]
    found = F.struct("gram", "n", F.array(*levels).alias("levels"))
    grams = grams.join(kinds, "lang", "left")
    text = [F.col("doc_id").alias("of"), "lang", "digest"]
    # as long as the document
    whole = held.join(grams, ["lang", "gram"]).groupBy(*text).agg(F.max("kinds").alias("kinds"), F.collect_list(found).alias("grams"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            losses = []
            for kinds, rows in zip(batch.column("kinds").to_pylist(), batch.column("grams"), strict=True):
                losses.append(_settled(rows.as_py(), kinds or 0, order))
            known = [batch.column(c) for c in ("of", "lang", "digest")]
            yield pa.RecordBatch.from_arrays([*known, *[pa.array(c, pa.float64()) for c in zip(*losses, strict=True)]], ["of", "lang", "digest", "loss", "apart"])

    losses = whole.mapInArrow(settle, f"of {kind}, lang string, digest long, loss double, apart double")
    losses = losses.withColumnsRenamed({"lang": "of_lang", "digest": "of_digest"})
    same = stats["doc_id"].eqNullSafe(losses["of"]) & (stats["lang"] == losses["of_lang"]) & (stats["digest"] == losses["of_digest"])
    return stats.join(losses, same, "left").drop("of", "of_lang", "of_digest")


# Verdict


#: For each loss the share of documents beyond a tail, that share's place on the normal curve, and the band's deviations.
BANDS = {"loss": (0.1, 1.2816, 4.0), "apart": (0.05, 1.6449, 6.0)}
LEAST = 0.5  # nats by which a character's logarithm spreads at least: equal texts must not close a band


def judge(scored: DataFrame, keep, bands: dict[str, tuple[float, float, float]] = BANDS, least: float = LEAST) -> DataFrame:
    """Add ``base_failed``, ``lower`` and ``upper`` loss and ``kept``; ``apart`` goes.

    Each loss has a band around its language's median over the documents that pass the base rules. A mean over n
    characters strays by a root of n less than one character, so a band reaches so many robust deviations of the distance
    times the root of n, divided by the root of the document's n: short texts have room, long ones do not. The deviation
    of a side is that of the quartiles or of its tail, whichever is more, so a language tag that covers several kinds of
    text has room for each; junk that makes up more than a tail's share of a language widens its band. A text that is all repetition, or known by heart, leaves by the lower bound; one unlike
    the others leaves by the upper bound of ``apart``, where its own n-grams do not speak for it. ``loss``, ``lower``
    and ``upper`` of a row are those of the first loss out of its band, else of ``apart``. A document without a loss
    has no band to leave.
    """
    based = scored.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
    sound = based.where("not base_failed")
    # sketches of bounded size over every document; one row for each language, whose size Spark knows as it is written
    middles = keep(sound.groupBy("lang").agg(*[F.percentile_approx(c, 0.5, 10_000).alias(f"{c}_middle") for c in bands]))
    root = F.sqrt(F.greatest(F.col("word_chars") + F.col("n_words"), F.lit(1)))
    far = {c: (F.col(c) - F.col(f"{c}_middle")) * root for c in bands}
    cuts = {c: [tail, 0.25, 0.75, 1 - tail] for c, (tail, _, _) in bands.items()}
    quantiles = sound.join(middles, "lang").groupBy("lang").agg(*[F.percentile_approx(d, cuts[c], 10_000).alias(c) for c, d in far.items()])
    sides = []
    for c, (_, normal, _) in bands.items():
        both = (F.col(c)[2] - F.col(c)[1]) / 1.349
        sides.append(F.greatest(both, -F.col(c)[0] / normal, F.lit(least)).alias(f"{c}_below"))
        sides.append(F.greatest(both, F.col(c)[3] / normal, F.lit(least)).alias(f"{c}_above"))
    out = based.join(middles, "lang", "left").join(keep(quantiles.select("lang", *sides)), "lang", "left")
    row, inside = {}, {}
    for c, (_, _, deviations) in bands.items():
        low, high = (F.col(f"{c}_middle") + sign * deviations * F.col(f"{c}_{side}") / root for sign, side in ((-1, "below"), (1, "above")))
        row[c] = F.struct(F.col(c).alias("loss"), low.alias("lower"), high.alias("upper"))
        inside[c] = F.coalesce(F.col(c).between(low, high), F.lit(True))
    out = out.withColumn("__row", F.when(~inside["loss"], row["loss"]).otherwise(row["apart"]))
    shown = [F.col("__row")[c].alias(c) for c in ("loss", "lower", "upper")]
    out = out.select(*[c for c in based.columns if c not in bands], *shown)
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.expr("loss between lower and upper"), F.lit(True)))


def quality_rules(docs: DataFrame, keep, order: int = ORDER, send_rows: int = SEND_ROWS, carry: bool = False) -> DataFrame:
    """One row per row of ``docs``: STATS, ``loss``, ``base_failed``, ``lower``, ``upper``, ``kept``.

    ``keep`` writes a table to shared storage and reads it back. With ``carry`` each row has its ``text`` and, as ``record``,
    its other columns, so that a verdict needs no join to be put into effect.
    """
    model = keep(kneser_ney(keep(count_grams(docs, order)), order, keep))
    return judge(keep(score(docs, model, order, send_rows, carry)), keep)
