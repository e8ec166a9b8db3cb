"""Order MinHash fingerprints of whole texts, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a k-mer, minimal k-mers of a tuple, and classes of k-mers, each of which gives one tuple.
K, TUPLE, CLASSES = 5, 2, 64
#: A packed k-mer is its hash (upper bits) and its place in the text (lower bits).
PLACE_BITS = 26
BLANKS = "[ \\t\\n\\x0B\\f\\r]+"


def _let(value: Column, body) -> Column:
    """Compute a value once and use it in an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _upper(hash_: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(hash_, PLACE_BITS), PLACE_BITS)


def _hash_of(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, PLACE_BITS)


def _packed_kmers(text: Column) -> Column:
    """Hash and place of every k-mer, sorted by hash, then place. A text of fewer words is one k-mer."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")

    def kmers(hashes: Column) -> Column:
        n = F.size(hashes)
        last = F.greatest(n - K, F.lit(0))
        some = F.transform(
            F.sequence(F.lit(0), last),
            lambda i: _upper(F.xxhash64(*[F.get(hashes, i + j) for j in range(K)])).bitwiseOR(i.cast("long")),
        )
        return F.when(n > 0, F.array_sort(some)).otherwise(F.array().cast("array<bigint>"))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), kmers)


def _numbered(packed: Column) -> Column:
    """Give each occurrence of a k-mer a hash of its own: the first keeps the k-mer's, others mix in their number.

    The number of an occurrence is its distance from the first one in the sorted array. Only repeated k-mers need it;
    it is found by pointer jumping over these, in as many rounds as their number has bits.
    """

    def repeated(x: Column, i: Column) -> Column:
        return (i > 0) & (_hash_of(x) == _hash_of(F.get(packed, i - 1)))

    def number(again: Column) -> Column:
        start = F.transform(again, lambda x, i: F.when((i > 0) & (_hash_of(x) == _hash_of(F.get(again, i - 1))), i - 1).otherwise(i))
        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(again) + 1)).cast("int"))
        firsts = F.aggregate(rounds, start, lambda at, _: F.transform(at, lambda i: F.get(at, i)))
        mask = F.lit((1 << PLACE_BITS) - 1)
        return _let(
            firsts,
            lambda first: F.transform(
                again, lambda x, i: _upper(F.xxhash64(_hash_of(x), i - F.get(first, i) + 1)).bitwiseOR(x.bitwiseAND(mask).cast("long"))
            ),
        )

    again = F.filter(packed, repeated)
    once = F.filter(packed, lambda x, i: ~repeated(x, i))
    return _let(again, lambda a: F.when(F.size(a) == 0, packed).otherwise(F.array_sort(F.concat(once, number(a)))))


def _signature(numbered: Column) -> Column:
    """The tuple of each class: hash of its minimal k-mers in the order of the text, with the class in the upper bits."""
    bits = CLASSES.bit_length() - 1
    kind = lambda x: F.shiftrightunsigned(x, 64 - bits)
    mask = F.lit((1 << PLACE_BITS) - 1)

    def tuples(few: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            own = F.array_compact(F.array(*[F.when(kind(F.get(few, i + j)) == kind(x), F.get(few, i + j)) for j in range(TUPLE)]))
            placed = F.array_sort(F.transform(own, lambda y: F.struct(y.bitwiseAND(mask).alias("at"), _hash_of(y).alias("h"))))
            body = F.shiftrightunsigned(F.xxhash64(F.transform(placed, lambda s: s["h"])), bits)
            first = (i == 0) | (kind(F.get(few, i - 1)) != kind(x))
            return F.when(first, F.shiftleft(kind(x), 64 - bits).bitwiseOR(body))

        return F.array_compact(F.transform(few, one))

    least = F.filter(numbered, lambda x, i: (i < TUPLE) | (kind(F.get(numbered, i - TUPLE)) != kind(x)))
    return _let(least, tuples)


def signature(text: Column) -> Column:
    """Order MinHash signature: an array of longs, one for each class that has a k-mer.

    K-mers are runs of K words (a shorter text is one k-mer; a blank one has none), told apart by their occurrence
    number. Their hashes deal them into CLASSES classes; in each class the TUPLE smallest are taken, put in the order
    of the text and hashed together. Moving text breaks tuples, as in an edit distance, and one pass serves all
    classes.
    """
    return _let(_packed_kmers(text), lambda p: _let(_numbered(p), _signature))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the TUPLE-th root of the share of classes whose tuples agree, which estimates the share of k-mers kept.

    Classes without a k-mer in either text do not count; two blank texts have likeness 1.
    """
    classes = lambda s: F.transform(s, lambda x: F.shiftrightunsigned(x, 64 - (CLASSES.bit_length() - 1)))
    used = F.size(F.array_union(classes(a), classes(b)))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.pow(F.size(F.array_intersect(a, b)) / used, F.lit(1.0 / TUPLE)))


def fingerprint(signature_: Column) -> Column:
    """The signature as hexadecimal digits, 16 a tuple; empty for a blank text."""
    return F.lower(F.array_join(F.transform(signature_, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def with_next(docs: DataFrame, doc_id: str, columns: list[str], ranges: int) -> DataFrame:
    """Add ``next_<column>``: the value of the row with the next id; after the last row comes the first.

    Ids are cut into ranges at approximate percentiles, which are ids of the table. A row that begins a range is also
    sent, as a guest, to the range before it (the first row to the last range), so one shuffle is enough and a range
    knows what follows its end.
    """
    cuts = docs.agg(F.percentile_approx(doc_id, [i / ranges for i in range(ranges)], 100_000), F.min(doc_id), F.count(F.lit(1))).first()
    bounds = sorted(({*cuts[0]} if cuts[0] else set()) | ({cuts[1]} if cuts[1] is not None else set()))
    starts = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    last = max(0, len(bounds) - 1)
    # Null ids come first, in range 0; with them, the first row of all is the guest of the last range.
    own = F.greatest(F.size(F.filter(starts, lambda b: b <= F.col(doc_id))) - 1, F.lit(0))
    begins = F.array_contains(starts, F.col(doc_id)) | F.col(doc_id).isNull()
    guest = F.when(begins & (own > 0), F.array(own, own - 1)).when(begins, F.array(own, F.lit(-1))).otherwise(F.array(own))
    rows = docs.select("*", own.alias("_own"), F.explode(guest).alias("_to"))
    rows = rows.withColumns({"_guest": F.col("_to") != F.col("_own"), "_range": F.when(F.col("_to") < 0, F.lit(last)).otherwise(F.col("_to"))})
    order = Window.partitionBy("_range").orderBy("_guest", F.col(doc_id).asc_nulls_first(), F.xxhash64(*columns), columns[0])
    follows = {f"next_{c}": F.lead(F.struct(c)).over(order)[c] for c in columns}
    return rows.withColumns(follows).filter("not _guest").drop("_own", "_to", "_guest", "_range")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of whole texts and of their edited forms.

    Gives ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. The edited text
    has its last floor(n/2) code points replaced by the first as many (or all) of the next row's text in ascending
    order of the id (null ids first; equal ids by a hash of the text); after the last row comes the first, and a
    single row follows itself. Null texts count as empty. Other columns are ignored; an empty table gives no rows.
    """
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranges = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = with_next(given.withColumn("s", signature(F.col("text"))), "doc_id", ["text", "s"], ranges)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - half), F.substr(F.col("next_text"), F.lit(1), half))
    texts = pairs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "s", F.col("next_s").alias("x"))
    signed = texts.withColumns({"edited_sha256": F.sha2("edited", 256), "e": signature(F.col("edited"))})
    return signed.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("s")).alias("fingerprint"), fingerprint(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("e")).alias("near_edited"), likeness(F.col("s"), F.col("x")).alias("near_next"),
    )
