"""Document fingerprints: a Merkle tree over paragraphs and sections.

Built from DataFrame functions only. A paragraph is a line; its node is the SHA-256 of its text. A section ends after a
paragraph whose digest says so (one in eight on average), so that an insertion moves no other section's borders; its node is
the digest of its paragraphs' digests, and the root that of the sections'. Equal texts have equal roots, different ones
different roots; where roots differ, equal section digests are passed over and the differing paragraphs tell where the edit is.

Below the paragraphs, a text is cut in pieces of some 40 characters that end at a word's end and are compared by their 64-bit
hashes. The likeness of two texts is the number of pieces in common over that of the text with more of them: of distinct pieces
(``near_*``, as the contract's SQL counts them), or of all pieces with a repeated one as often as it comes (``kept_*``).

Defined results: null counts as empty; two empty texts have likeness 1, an empty and another text 0. The next document of
``with_edits`` is taken in descending id; rows with equal ids follow each other by a hash of their texts, rows that are equal
in both count as one document and have equal results; rows with a null id come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.shared import stored

# At least so many characters, and on to the end of the word and the space behind it.
PIECE = r"(?s).{1,40}\S*\s*"
# Leading hex digits of a paragraph's digest that end a section.
SECTION_END = ("0", "1")


def paragraphs(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def paragraph_digests(paras: Column) -> Column:
    return F.transform(paras, lambda p: F.sha2(p, 256))


def section_digests(digests: Column) -> Column:
    marked = F.transform(digests, lambda d: F.concat(d, F.when(F.substring(d, 1, 1).isin(*SECTION_END), "|").otherwise(" ")))
    sections = F.filter(F.split(F.array_join(marked, ""), r"\|"), lambda s: s != "")
    return F.transform(sections, lambda s: F.sha2(s, 256))


def root_digest(sections: Column) -> Column:
    return F.sha2(F.array_join(sections, " "), 256)


def piece_hashes(paras: Column) -> Column:
    """Distinct hashes of the pieces of all paragraphs."""
    return F.array_distinct(all_piece_hashes(paras))


def all_piece_hashes(paras: Column) -> Column:
    cut = F.flatten(F.transform(paras, lambda p: F.regexp_extract_all(p, F.lit(PIECE), F.lit(0))))
    return F.transform(cut, lambda piece: F.xxhash64(piece))


def occurrences(values: Column) -> Column:
    """The hashes with the number of their occurrence within, so that a repeated one is in as often as it comes."""
    bound = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)

    def numbered(ordered: Column, starts: Column) -> Column:
        end = lambda j: F.coalesce(F.get(starts, j + 1), F.size(ordered))
        return F.flatten(F.transform(starts, lambda start, j: F.transform(
            F.sequence(start, end(j) - 1), lambda i: F.xxhash64(F.get(ordered, i), i - start)
        )))

    def of_sorted(ordered: Column) -> Column:
        starts = F.transform(ordered, lambda x, i: F.when(~x.eqNullSafe(F.get(ordered, i - 1)), i))
        return bound(F.array_compact(starts), lambda found: numbered(ordered, found))

    return bound(F.array_sort(values), of_sorted)


def likeness(pieces_a: Column, pieces_b: Column) -> Column:
    most = F.greatest(F.size(pieces_a), F.size(pieces_b))
    return F.when(most == 0, 1.0).otherwise(F.size(F.array_intersect(pieces_a, pieces_b)) / most)


def differing_paragraphs(digests_a: Column, sections_a: Column, digests_b: Column, sections_b: Column) -> Column:
    """Positions (from 0) of the paragraphs of b that are not in a; none where the sections are the same."""
    missing = F.array_except(digests_b, digests_a)
    places = F.transform(digests_b, lambda d, i: F.when(F.array_contains(missing, d), i))
    return F.when(sections_a == sections_b, F.array().cast("array<int>")).otherwise(F.array_compact(places))


def with_tree(df: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """The rows with ``<prefix>fingerprint`` (the root), ``<prefix>sections``, ``<prefix>paragraphs`` (digests) and
    ``<prefix>pieces``; columns of these names are replaced."""
    df = df.withColumn("_paras", paragraphs(F.col(text_col)))
    df = df.withColumns({
        f"{prefix}paragraphs": paragraph_digests(F.col("_paras")), f"{prefix}pieces": piece_hashes(F.col("_paras"))
    }).drop("_paras")
    df = df.withColumn(f"{prefix}sections", section_digests(F.col(f"{prefix}paragraphs")))
    return df.withColumn(f"{prefix}fingerprint", root_digest(F.col(f"{prefix}sections")))


def next_keys(keys: DataFrame) -> DataFrame:
    """``doc_id, th, n`` in descending order of the id with ``next_id, next_th``; behind the last comes the first. A sort by
    ranges, a lead within each range, and the first rows of the ranges (one per partition) for the seams."""
    order = [F.desc_nulls_last("doc_id"), F.asc("th")]
    ranged = stored(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "merkle-order")
    within = Window.partitionBy("part").orderBy(*order)
    ahead = ranged.withColumns({
        "place": F.row_number().over(within), "after": F.lead(F.struct("doc_id", "th")).over(within)
    })
    firsts = ahead.where("place = 1").select("part", F.struct("doc_id", "th").alias("first"))
    # one row per partition of the sort
    ring = Window.orderBy("part")
    seams = firsts.select(
        "part", F.coalesce(F.lead("first").over(ring), F.first("first").over(ring)).alias("seam")
    )
    joined = ahead.join(F.broadcast(seams), "part")
    following = F.when(F.col("after").isNotNull(), F.col("after")).otherwise(F.col("seam"))
    return joined.select(
        "doc_id", "th", "n", following["doc_id"].alias("next_id"), following["th"].alias("next_th")
    )


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_chars, edited`` (the last third of the text replaced by as many first characters of the
    next document, or all of it), the fingerprints of both, ``near_edited``, ``near_next``, ``kept_edited``, ``kept_next`` and ``edited_at`` (the paragraphs
    of the edited text that are new)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))
    # an id that may be null, as a key that joins
    own = own.withColumns({
        "th": F.xxhash64("text"), "n": F.length("text").cast("bigint"),
        "key": F.coalesce(F.col("doc_id").cast("string"), F.lit("-")),
    })
    follow = stored(next_keys(own.select("doc_id", "th", "n").distinct()), "merkle-next").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("key"), "th", F.floor(F.col("n") / 3).alias("take"),
        F.coalesce(F.col("next_id").cast("string"), F.lit("-")).alias("next_key"), "next_th", "next_id",
    )
    # Each text is moved once to its key; from there its beginning goes to the document before it. Both branches use the same
    # columns of it, else the planner would prune them differently and move the texts twice.
    placed = own.repartition("key", "th")
    ahead = follow.select(
        F.col("next_key").alias("key"), F.col("next_th").alias("th"), F.col("key").alias("to_key"), F.col("th").alias("to_th"),
        "take", "next_id",
    )
    sent = (
        placed.dropDuplicates(["key", "th"]).join(ahead, ["key", "th"])
        .select("to_key", "to_th", "take", "n", "doc_id", "next_id", "text", paragraphs(F.col("text")).alias("paras"))
        .select(
            F.col("to_key").alias("key"), F.col("to_th").alias("th"), F.expr("CASE WHEN doc_id <=> next_id THEN substring(text, 1, int(least(take, n))) END").alias("filling"),
            piece_hashes(F.col("paras")).alias("next_pieces"), occurrences(all_piece_hashes(F.col("paras"))).alias("next_counted"), "take",
        )
    )
    both = placed.join(sent, ["key", "th"])
    edited = both.withColumn("edited", F.expr("concat(substring(text, 1, int(n - take)), filling)")).drop("filling")
    trees = with_tree(with_tree(edited), "edited", "edited_")
    counted = lambda column: occurrences(all_piece_hashes(paragraphs(F.col(column))))
    return trees.select(
        "doc_id", F.col("n").alias("n_chars"), "edited", "fingerprint", "edited_fingerprint",
        likeness(F.col("pieces"), F.col("edited_pieces")).alias("near_edited"),
        likeness(F.col("pieces"), F.col("next_pieces")).alias("near_next"),
        likeness(counted("text"), counted("edited")).alias("kept_edited"),
        likeness(counted("text"), F.col("next_counted")).alias("kept_next"),
        differing_paragraphs(
            F.col("paragraphs"), F.col("sections"), F.col("edited_paragraphs"), F.col("edited_sections")
        ).alias("edited_at"),
    )
