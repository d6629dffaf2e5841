"""Terms of many reviews counted together in arrays.

Spark cuts texts into words and passes them on in Arrow batches; a task numbers
the words of some reviews, so that a pair of words is one number too, and sends
each topic's term once for all of these reviews.  Neither a text's terms nor a
common term's reviews become one row each before they are counted.

Counts of different tasks meet in buckets of terms, whose number grows with the
table: a row carries all that a slice of reviews has for a bucket, and a bucket
is summed up in one group of bounded size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Words counted together; a longer review is counted alone.
WORDS_AT_ONCE = 1 << 20
#: Summed reviews that a task holds before it passes them on.
REVIEWS_HELD = 1 << 22
#: Reviews whose sums from all tasks meet in one group.
REVIEWS_A_PART = 1 << 13
#: Parts that a task passes on in one batch.
PARTS_AT_ONCE = 1 << 6
#: Kept words of the whole table for each bucket of terms.
WORDS_A_BUCKET = 1 << 20


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of whole reviews with about ``most`` words each."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(batch.column("words")), 0), np.int64))
    low = 0
    while low < batch.num_rows:
        spent = ends[low - 1] if low else 0
        high = max(int(np.searchsorted(ends, spent + most, "right")), low + 1)
        yield batch.slice(low, high - low)
        low = high


def _occurrences(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words, and for every word and pair inside a review its number and its review's row.

    A word's number is its place, a pair's ``v + left * v + right`` for ``v`` words.
    """
    lists = batch.column("words")
    known = lists.flatten().dictionary_encode()
    words = known.dictionary
    kept = ~np.asarray(pc.is_in(words, value_set=pa.array(X.VECTORIZER_STOP_WORDS, words.type)), bool)
    codes = np.asarray(known.indices, np.int64)
    row = np.repeat(np.arange(batch.num_rows), np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64))
    real = kept[codes]
    codes, row = codes[real], row[real]
    inside = np.flatnonzero(row[1:] == row[:-1])
    pairs = len(words) * (1 + codes[inside]) + codes[inside + 1]
    return words, np.concatenate((codes, pairs)), np.concatenate((row, row[inside]))


def _term_batches(words: pa.Array, terms: np.ndarray, columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    """Rows with their terms spelled out: words first, then pairs."""
    size = len(words)
    single = terms < size
    for chosen in (np.flatnonzero(single), np.flatnonzero(~single)):
        if not len(chosen):
            continue
        some = terms[chosen]
        if some[0] < size:
            names = words.take(pa.array(some))
        else:
            names = pc.binary_join_element_wise(words.take(pa.array(some // size - 1)), words.take(pa.array(some % size)), " ")
        yield pa.RecordBatch.from_pydict({"term": names, **{name: values.take(pa.array(chosen)) for name, values in columns.items()}})


def _worded(rows: DataFrame) -> DataFrame:
    """The rows with their words, which a table may carry already."""
    words = F.col("words") if "words" in rows.columns else X.terms(F.col("text"))
    return rows.select("topic_id", "source_row", words.alias("words"))


def _topics(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    known = batch.column("topic_id").dictionary_encode(null_encoding="encode")
    return known.dictionary, np.asarray(known.indices, np.int64)


def term_counts(rows: DataFrame, most: int = WORDS_AT_ONCE) -> DataFrame:
    """``term, topic_id, tf`` of words and pairs inside reviews, one row for each slice of reviews that holds the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, most):
                words, terms, row = _occurrences(part)
                topics, topic = _topics(part)
                width = len(words) * (len(words) + 1)
                found, tf = np.unique(topic[row] * width + terms, return_counts=True)
                if len(found):
                    yield from _term_batches(words, found % width, {
                        "topic_id": topics.take(pa.array(found // width)), "tf": pa.array(tf.astype(np.int64))})

    return _worded(rows).mapInArrow(run, f"term string, topic_id {dict(rows.dtypes)['topic_id']}, tf bigint")


def _hits(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """Occurrences by topic and term, then by review: the different keys, where each one's hits begin, and every hit's row and times."""
    size = int(row.max()) + 1
    if int(key.max()) < (1 << 63) // size - 1:
        # One number for term and review sorts much faster than an order of them.
        both = np.sort(key * size + row)
        hit = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
        times, both = np.diff(np.append(hit, len(both))), both[hit]
        key, row = both // size, both % size
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        return key[heads], heads, row, times
    # Words and pairs come in row order, so a stable sort keeps every term's reviews together.
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    fresh = np.concatenate(([True], key[1:] != key[:-1]))
    hit = np.flatnonzero(fresh | np.concatenate(([True], row[1:] != row[:-1])))
    heads = np.flatnonzero(fresh[hit])
    return key[hit[heads]], heads, row[hit], np.diff(np.append(hit, len(key)))


def _numbers(words: pa.Array, terms: list[str]) -> np.ndarray:
    """The numbers of those terms whose words occur."""
    parts = [term.split(" ") for term in terms]
    first, last = [np.asarray(pc.fill_null(pc.index_in(pa.array([part[at] for part in parts], words.type), words), -1), np.int64) for at in (0, -1)]
    pair = np.array([len(part) > 1 for part in parts], bool)
    return np.where(pair, len(words) * (1 + first) + last, first)[(first >= 0) & (last >= 0)]


def postings(rows: DataFrame, most: int = WORDS_AT_ONCE, only: list[str] | None = None) -> DataFrame:
    """``term, topic_id, hits``: the reviews of a slice that hold the term (``source_row``), and how often (``times``).

    Rows that share a topic and a number are hits of their own.  With ``only``, other terms are left out before they are
    sorted or spelled out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, most):
                words, terms, row = _occurrences(part)
                if only is not None:
                    chosen = np.isin(terms, _numbers(words, only))
                    terms, row = terms[chosen], row[chosen]
                if not len(terms):
                    continue
                topics, topic = _topics(part)
                width = len(words) * (len(words) + 1)
                found, heads, row, times = _hits(topic[row] * width + terms, row)
                hits = pa.ListArray.from_arrays(pa.array(np.append(heads, len(row)), pa.int32()), pa.StructArray.from_arrays([
                    part.column("source_row").take(pa.array(row)), pa.array(times, pa.int64()),
                ], ["source_row", "times"]))
                yield from _term_batches(words, found % width, {"topic_id": topics.take(pa.array(found // width)), "hits": hits})

    kinds = dict(rows.dtypes)
    return _worded(rows).mapInArrow(run, f"term string, topic_id {kinds['topic_id']}, hits array<struct<source_row: {kinds['source_row']}, times: bigint>>")


# -- buckets of terms ------------------------------------------------------

def term_bucket(term: Column, buckets: int) -> Column:
    """The bucket of a word or a pair, from its first and last word."""
    first, last = [F.crc32(F.substring_index(term, " ", side).cast("binary")) for side in (1, -1)]
    return F.pmod(first * F.lit(31) + last, F.lit(buckets)).cast("int")


def _buckets(words: pa.Array, terms: np.ndarray, buckets: int) -> np.ndarray:
    """``term_bucket`` of numbered terms."""
    size = len(words)
    sums = np.array([zlib.crc32(word) for word in words.cast(pa.binary()).to_pylist()], np.int64)
    single = terms < size
    first, last = np.where(single, terms, terms // size - 1), np.where(single, terms, terms % size)
    return (sums[first] * 31 + sums[last]) % buckets


def _spelled(words: pa.Array, terms: np.ndarray) -> pa.Array:
    """Numbered terms as texts, in their order."""
    size = len(words)
    single = terms < size
    alone, pairs = np.flatnonzero(single), terms[~single]
    names = pa.concat_arrays([words.take(pa.array(terms[alone])), pc.binary_join_element_wise(
        words.take(pa.array(pairs // size - 1)), words.take(pa.array(pairs % size)), " ")])
    at = np.empty(len(terms), np.int64)
    at[alone], at[~single] = np.arange(len(alone)), np.arange(len(alone), len(terms))
    return names.take(pa.array(at))


def _lists(bucket: np.ndarray, columns: dict[str, pa.Array]) -> tuple[pa.Array, dict[str, pa.Array]]:
    """Every bucket once, with lists of what stands under it; ``bucket`` is sorted."""
    heads = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    ends = pa.array(np.append(heads, len(bucket)), pa.int32())
    return pa.array(bucket[heads], pa.int32()), {name: pa.ListArray.from_arrays(ends, values) for name, values in columns.items()}


def _flat(table: pa.Table, name: str) -> pa.Array:
    parts = [chunk.flatten() for chunk in table.column(name).chunks]
    return pa.concat_arrays(parts) if parts else pa.array([], table.schema.field(name).type.value_type)


def _codes(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    known = values.dictionary_encode(null_encoding="encode")
    return known.dictionary, np.asarray(known.indices, np.int64)


def bucket_counts(rows: DataFrame, buckets: int, most: int = WORDS_AT_ONCE) -> DataFrame:
    """``bucket, terms, topics, tfs``: the counts of a slice of reviews, in one row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, most):
                words, terms, row = _occurrences(part)
                if not len(terms):
                    continue
                topics, topic = _topics(part)
                width = len(words) * (len(words) + 1)
                found, tf = np.unique(topic[row] * width + terms, return_counts=True)
                bucket = _buckets(words, found % width, buckets)
                order = np.argsort(bucket, kind="stable")
                found = found[order]
                names, lists = _lists(bucket[order], {
                    "terms": _spelled(words, found % width), "topics": topics.take(pa.array(found // width)),
                    "tfs": pa.array(tf[order].astype(np.int64))})
                yield pa.RecordBatch.from_pydict({"bucket": names, **lists})

    return _worded(rows).mapInArrow(run, f"bucket int, terms array<string>, topics array<{dict(rows.dtypes)['topic_id']}>, tfs array<bigint>")


def summed_counts(counts: DataFrame) -> DataFrame:
    """``topic_id, term, tf, f``: every topic's count of a term, and that of all topics."""

    def add_up(table: pa.Table) -> pa.Table:
        names, term = _codes(_flat(table, "terms"))
        topics, topic = _codes(_flat(table, "topics"))
        tfs = np.asarray(_flat(table, "tfs"), np.int64)
        key = term * len(topics) + topic
        order = np.argsort(key, kind="stable")
        key, heads = key[order], np.zeros(0, np.int64)
        if len(key):
            heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        tf = np.add.reduceat(tfs[order], heads) if len(heads) else tfs
        found = key[heads]
        f = np.zeros(len(names), np.int64)
        np.add.at(f, found // len(topics), tf)
        return pa.table({
            "topic_id": topics.take(pa.array(found % len(topics))), "term": names.take(pa.array(found // len(topics))),
            "tf": pa.array(tf), "f": pa.array(f[found // len(topics)])})

    kind = dict(counts.dtypes)["topics"][len("array<"):-1]
    return counts.groupBy("bucket").applyInArrow(add_up, f"topic_id {kind}, term string, tf bigint, f bigint")


# -- scores out of the same buckets ------------------------------------------

def bucket_postings(rows: DataFrame, buckets: int, most: int = WORDS_AT_ONCE) -> DataFrame:
    """``bucket, terms, topics`` with the hits: every term has ``sizes`` of the bucket's ``reviews`` and ``times``.

    ``rows`` carry their topic's number of terms, ``total``; a bucket gets ``totals`` of its ``owners``, the different topics.
    A term's count is that of its hits; a term without hits counts once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, most):
                words, terms, row = _occurrences(part)
                if not len(terms):
                    continue
                topics, topic = _topics(part)
                width = len(words) * (len(words) + 1)
                found, heads, row, times = _hits(topic[row] * width + terms, row)
                sizes = np.diff(np.append(heads, len(row)))
                bucket = _buckets(words, found % width, buckets)
                order = np.argsort(bucket, kind="stable")
                bucket, found, sizes = bucket[order], found[order], sizes[order]
                hit = np.repeat(heads[order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(row))
                owner = found // width
                names, lists = _lists(bucket, {
                    "terms": _spelled(words, found % width), "topics": topics.take(pa.array(owner)), "sizes": pa.array(sizes, pa.int32())})
                total = np.zeros(len(topics), np.int64)
                total[topic] = np.asarray(part.column("total"), np.int64)
                # In order of the buckets, as they are first met.
                owners = np.asarray(_codes(pa.array(bucket * len(topics) + owner))[0], np.int64)
                _, owned = _lists(owners // len(topics), {
                    "owners": topics.take(pa.array(owners % len(topics))), "totals": pa.array(total[owners % len(topics)])})
                _, hits = _lists(np.repeat(bucket, sizes), {
                    "reviews": part.column("source_row").take(pa.array(row[hit])), "times": pa.array(times[hit], pa.int32())})
                yield pa.RecordBatch.from_pydict({"bucket": names, **lists, **owned, **hits})

    kinds = dict(rows.dtypes)
    return rows.select("topic_id", "source_row", "words", "total").mapInArrow(run, f"""bucket int, terms array<string>, topics array<{kinds['topic_id']}>,
        sizes array<int>, owners array<{kinds['topic_id']}>, totals array<bigint>, reviews array<{kinds['source_row']}>, times array<int>""")


def _products(table: pa.Table, average: float) -> tuple[dict[str, pa.Array], dict[str, pa.Array], dict[str, pa.Array]]:
    """Of all postings of a bucket: the summed counts, every topic's squared weights, and every review's products of its own
    and its topic's weights."""
    names, term = _codes(_flat(table, "terms"))
    topics, topic = _codes(_flat(table, "topics"))
    sizes, totals, times = (np.asarray(_flat(table, name), np.int64) for name in ("sizes", "totals", "times"))
    found, entry = _codes(pa.array(term * len(topics) + topic))
    found = np.asarray(found, np.int64)
    of = np.repeat(entry, sizes)
    # Whole numbers, exact in doubles.
    tf = (np.bincount(of, times, len(found)) + np.bincount(entry[sizes == 0], minlength=len(found))).astype(np.int64)
    total = np.zeros(len(topics), np.int64)
    total[np.asarray(pc.index_in(_flat(table, "owners"), topics), np.int64)] = totals
    total = total[found % len(topics)]
    f = np.bincount(found // len(topics), tf, len(names)).astype(np.int64)[found // len(topics)]
    counts = {"topic_id": topics.take(pa.array(found % len(topics))), "term": names.take(pa.array(found // len(topics))), "tf": pa.array(tf), "f": pa.array(f)}
    idf = np.log(1.0 + average / f)
    weight = np.sqrt(tf / total) * idf
    counts["weight"] = pa.array(weight)

    reviews, review = _codes(_flat(table, "reviews"))
    lengths = {"topic_id": topics, "source_row": pa.nulls(len(topics), reviews.type), "product": pa.array(np.zeros(len(topics))),
               "square": pa.array(np.bincount(found % len(topics), weight * weight, len(topics)))}
    rows, row = _codes(pa.array(found[of] % len(topics) * max(len(reviews), 1) + review))
    rows = np.asarray(rows, np.int64)
    # Rows that share a topic and a number are one review, so their terms are counted together.
    key = of * max(len(rows), 1) + row
    apart = np.sort(key)
    if (apart[1:] == apart[:-1]).any():
        order = np.argsort(key, kind="stable")
        key = key[order]
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        times, of, row = np.add.reduceat(times[order], heads), of[order][heads], row[order][heads]
    value = np.sqrt(times) * idf[of]
    # A bucket may have pairs across borders alone; of no rows, the sums would be whole numbers.
    product, square = (np.bincount(row, values, len(rows)).astype(np.float64) for values in (value * weight[of], value * value))
    return counts, lengths, {
        "topic_id": topics.take(pa.array(rows // max(len(reviews), 1))), "source_row": reviews.take(pa.array(rows % max(len(reviews), 1))),
        "product": pa.array(product), "square": pa.array(square)}


def _contenders(counts: dict[str, pa.Array], k: int) -> dict[str, pa.Array]:
    """The counts of a bucket that can be among a topic's first ``k`` by weight, ties in order of the terms.

    Weights within rounding of the ``k``-th are kept; of terms with the same counts, so the same weight, the first ``k``.
    """
    _, topic = _codes(counts["topic_id"])
    weight, tf, f = (np.asarray(counts[name]) for name in ("weight", "tf", "f"))
    order = np.lexsort((-weight, topic))
    heads = np.flatnonzero(np.concatenate(([True], np.diff(topic[order]) != 0))) if len(order) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(heads, len(order)))
    bound = weight[order[heads + np.minimum(sizes, k) - 1]] if len(order) else np.zeros(0)
    kept = order[weight[order] >= np.repeat(bound, sizes) * (1 - 1e-9)]
    place = np.empty(len(kept), np.int64)
    place[np.asarray(pc.sort_indices(counts["term"].take(pa.array(kept))), np.int64)] = np.arange(len(kept))
    again = np.lexsort((place, f[kept], tf[kept], topic[kept]))
    alike = np.stack([values[kept][again] for values in (topic, tf, f)])
    heads = np.flatnonzero(np.concatenate(([True], (alike[:, 1:] != alike[:, :-1]).any(axis=0)))) if len(kept) else np.zeros(0, np.int64)
    first = np.arange(len(kept)) - np.repeat(heads, np.diff(np.append(heads, len(kept)))) < k
    at = pa.array(kept[again][first])
    return {name: values.take(at) for name, values in counts.items()}


def _added(held: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(held).group_by(["topic_id", "source_row"], use_threads=False).aggregate(
        [("product", "sum"), ("square", "sum")]).rename_columns({"product_sum": "product", "square_sum": "square"})


def _parts(reviews: pa.Array, parts: int) -> np.ndarray:
    """The part of each review, from its number."""
    number = np.asarray(pc.fill_null(reviews.cast(pa.int64(), safe=False), 0), np.int64).view(np.uint64)
    return ((number * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % parts


def summed_products(sent: DataFrame, average: float, parts: int, listed: bool = True, leading: int = 0) -> DataFrame:
    """``topic_id, term, tf, f`` as ``summed_counts``, and without a term ``part, topics, reviews, products, squares`` for ``review_sums``.

    A task works bucket by bucket and adds up what its buckets have for a review.  It passes that on in one row for each part
    of the reviews: almost every bucket has something for every review, so rows of reviews would grow with tasks times reviews.
    Without ``listed`` the terms stay inside but for those that can be among a topic's first ``leading`` by weight, and part -1
    has the sums of every topic's squared weights.
    """
    kinds = dict(sent.dtypes)
    schema = f"""topic_id {kinds['topics'][6:-1]}, term string, tf bigint, f bigint,
        part int, topics {kinds['topics']}, reviews {kinds['reviews']}, products array<double>, squares array<double>"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reviews: list[pa.Table] = []
        lengths: list[pa.Table] = []

        def whole(columns: dict[str, pa.Array], like: pa.Table, at_once: int) -> Iterator[pa.RecordBatch]:
            topic, review = (like.schema.field(name).type for name in ("topics", "reviews"))
            kind = {"topic_id": topic.value_type, "term": pa.string(), "tf": pa.int64(), "f": pa.int64(), "part": pa.int32(), "topics": topic,
                    "reviews": review, "products": pa.list_(pa.float64()), "squares": pa.list_(pa.float64())}
            rows = len(next(iter(columns.values())))
            full = pa.table({name: columns[name].cast(type_) if name in columns else pa.nulls(rows, type_) for name, type_ in kind.items()})
            yield from full.to_batches(max_chunksize=at_once)

        def passed(held: list[pa.Table], like: pa.Table) -> Iterator[pa.RecordBatch]:
            done = _added(held).combine_chunks()
            columns = {name: _one(done.column(name)) for name in done.column_names}
            part = np.full(len(done), -1) if held is lengths else _parts(columns["source_row"], parts)
            order = np.argsort(part, kind="stable")
            at = pa.array(order)
            names, lists = _lists(part[order], {
                "topics": columns["topic_id"].take(at), "reviews": columns["source_row"].take(at),
                "products": columns["product"].take(at), "squares": columns["square"].take(at)})
            yield from whole({"part": names, **lists}, like, PARTS_AT_ONCE)

        for table in _by_bucket(batches):
            counts, squares, products = _products(table, average)
            reviews.append(pa.table(products))
            if listed:
                yield from whole(counts, table, 1 << 16)
            else:
                lengths.append(pa.table(squares))
                if leading:
                    yield from whole(_contenders(counts, leading), table, 1 << 16)
            for held in (reviews, lengths):
                if sum(some.num_rows for some in held) > 2 * REVIEWS_HELD:
                    held[:] = [_added(held)]
                    if held[0].num_rows > REVIEWS_HELD:
                        yield from passed(held, table)
                        held.clear()
        for held in (reviews, lengths):
            if sum(some.num_rows for some in held):
                yield from passed(held, table)

    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def review_sums(found: DataFrame) -> DataFrame:
    """``part, topic_id, source_row, product, square`` of the parts of ``summed_products``: a review's sums over all its terms."""
    kinds = dict(found.dtypes)

    def add_up(table: pa.Table) -> pa.Table:
        sums = _added([pa.table({name: _flat(table, of) for name, of in (
            ("topic_id", "topics"), ("source_row", "reviews"), ("product", "products"), ("square", "squares"))})])
        part = pa.array(np.full(len(sums), table.column("part")[0].as_py(), np.int32))
        return pa.table({"part": part, **{name: sums.column(name) for name in ("topic_id", "source_row", "product", "square")}})

    rows = found.where("part IS NOT NULL").select("part", "topics", "reviews", "products", "squares")
    return rows.groupBy("part").applyInArrow(
        add_up, f"part int, topic_id {kinds['topics'][6:-1]}, source_row {kinds['reviews'][6:-1]}, product double, square double")


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each bucket together; they come sorted by bucket."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        bucket = np.asarray(batch.column("bucket"))
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))).tolist() if len(bucket) else []
        for low, high in zip(cuts, [*cuts[1:], len(bucket)]):
            part = batch.slice(low, high - low)
            if held and held[0].column("bucket")[0] != part.column("bucket")[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)
