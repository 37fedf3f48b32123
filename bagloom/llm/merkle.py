"""Document fingerprints: a Merkle tree over leaves, paragraphs and sections, in SQL functions only.

A text is cut at line feeds into paragraphs, these at spaces into words; a leaf is LEAF
words of a paragraph, a section SECTION paragraphs. Leaves hash their text (md5), inner
nodes their children's hashes in order (sha256), so equal roots mean equal texts, and
walking from differing sections to differing paragraphs locates an edit.

A fingerprint is `root:sketch`: the root, then the SKETCH smallest distinct leaf hashes
(8 hexadecimal digits each). The likeness of two fingerprints is the share of the SKETCH
smallest of both sketches that lie in both: the Jaccard likeness of the leaf sets, exact up
to SKETCH leaves (some thousand words) and estimated beyond. compare_trees has fingerprints of
the whole tree instead, `root:sections:paragraphs`, and the exact likeness of all leaves.

Next documents are found without one global sort: ids are cut at quantiles into as many
ranges as the session has shuffle partitions, each range is sorted by itself, and the first
row of a range also stands, marked, at the end of the range before it (of the last one for
the first range). Only the quantiles and one id and hash per range reach the driver.

Defined results: null texts are empty; an empty text is one paragraph with one empty leaf.
Null ids come first. Equal ids are in order of their text's hash, then text. A sole
document is its own next one. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagloom.llm.common import shards

LEAF, SECTION, SKETCH = 8, 8, 128


def groups(items: Column, size: int, node) -> Column:
    """node() of each run of `size` items."""
    return F.transform(F.sequence(F.lit(0), ((F.size(items) - 1) / size).cast("int")), lambda i: node(F.slice(items, i * size + 1, F.lit(size))))


def leaves(text: Column) -> Column:
    """Leaf hashes by paragraph."""
    by_word = F.transform(F.split(text, "\n", -1), lambda p: F.split(p, " ", -1))
    return F.transform(by_word, lambda w: groups(w, LEAF, lambda x: F.md5(F.array_join(x, " "))))


def tree(text: Column) -> Column:
    """struct(root, sections, paragraphs, sketch), each level evaluated once."""
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    hashed = lambda nodes: F.sha2(F.array_join(nodes, ""), 256)
    sketch = lambda found: F.slice(F.array_sort(F.array_distinct(F.transform(F.flatten(found), lambda x: F.substring(x, 1, 8)))), 1, SKETCH)
    top = lambda found, paragraphs: let(groups(paragraphs, SECTION, hashed), lambda sections: F.struct(hashed(sections).alias("root"), sections.alias("sections"), paragraphs.alias("paragraphs"), sketch(found).alias("sketch")))
    return let(leaves(text), lambda found: let(F.transform(found, hashed), lambda paragraphs: top(found, paragraphs)))


def whole_tree(text: Column) -> Column:
    """struct(root, sections, paragraphs, leaves): as tree(), with all distinct leaf hashes instead of a sketch."""
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    hashed = lambda nodes: F.sha2(F.array_join(nodes, ""), 256)
    top = lambda found, paragraphs: let(groups(paragraphs, SECTION, hashed), lambda sections: F.struct(hashed(sections).alias("root"), sections.alias("sections"), paragraphs.alias("paragraphs"), F.array_distinct(F.flatten(found)).alias("leaves")))
    return let(leaves(text), lambda found: let(F.transform(found, hashed), lambda paragraphs: top(found, paragraphs)))


def whole_fingerprint(t: Column) -> Column:
    """root:sections:paragraphs, from which differing branches can be found."""
    return F.concat_ws(":", t["root"], F.array_join(t["sections"], ""), F.array_join(t["paragraphs"], ""))


def shared(a: Column, b: Column) -> Column:
    """The share of equal leaves among all leaves of two trees, from 0 to 1."""
    both = F.size(F.array_intersect(a["leaves"], b["leaves"]))
    return both / (F.size(a["leaves"]) + F.size(b["leaves"]) - both)


def fingerprint(t: Column) -> Column:
    return F.concat(t["root"], F.lit(":"), F.array_join(t["sketch"], ""))


def likeness(a: Column, b: Column) -> Column:
    """Of two sketches, from 0 to 1."""
    least = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(F.array_intersect(least, a), b)) / F.size(least)


def sketch_of(fingerprints: Column) -> Column:
    """The sketch inside a fingerprint."""
    return F.regexp_extract_all(F.substring_index(fingerprints, ":", -1), F.lit("[0-9a-f]{8}"), 0)


def changed(a: Column, b: Column) -> Column:
    """Positions (from 0) of differing nodes of one level."""
    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)))


def located(a: Column, b: Column) -> Column:
    """Positions of differing paragraphs of two trees, looked for below differing sections only."""
    inside = lambda s: F.filter(F.sequence(s * SECTION, s * SECTION + SECTION - 1), lambda i: ~F.get(a["paragraphs"], i).eqNullSafe(F.get(b["paragraphs"], i)))
    return F.flatten(F.transform(changed(a["sections"], b["sections"]), inside))


def with_next(docs: DataFrame) -> tuple[DataFrame, Window]:
    """(docs with end marks: columns doc_id, text, __end), and the window in which the row after is the next document."""
    n = shards(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("__hash", F.xxhash64("text"))
    steps = [i / n for i in range(1, n)]
    bounds = sorted(set((docs.agg(F.percentile_approx("doc_id", steps)).first()[0] if steps else None) or []))
    part = F.lit(0)
    if bounds:
        part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("doc_id")))
    docs = docs.withColumn("__part", part)
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("__hash").alias("hash"))
    firsts = sorted((r[0], tuple(r[1])) for r in docs.groupBy("__part").agg(F.min(place)).collect())
    before = {p: firsts[k - 1][0] for k, (p, _) in enumerate(firsts)}
    known = docs.sparkSession.createDataFrame([(p, *key, before[p]) for p, key in firsts], "p int, known boolean, id long, hash long, before int")
    # one row per range, so its size is bounded by the number of shuffle partitions
    at = docs.join(F.broadcast(known), F.col("__part") == F.col("p"), "left")
    first = (F.col("known") == F.col("doc_id").isNotNull()) & (F.col("id") == F.coalesce("doc_id", F.lit(0))) & (F.col("hash") == F.col("__hash"))
    own = F.struct(F.col("__part").alias("part"), F.lit(False).alias("end"))
    also = F.struct(F.col("before").alias("part"), F.lit(True).alias("end"))
    dealt = at.select("doc_id", "text", "__hash", F.explode(F.when(first, F.array(own, also)).otherwise(F.array(own))).alias("__to"))
    dealt = dealt.select("doc_id", "text", "__hash", F.col("__to.part").alias("__part"), F.col("__to.end").alias("__end"))
    return dealt, Window.partitionBy("__part").orderBy("__end", F.col("doc_id").asc_nulls_first(), "__hash", "text")


def compare_edits(docs: DataFrame) -> DataFrame:
    """Each text's and its edited text's fingerprints, and their likeness; see the module."""
    dealt, order = with_next(docs)
    dealt = dealt.withColumn("__next", F.lead("text").over(order)).withColumn("__tree", tree(F.col("text")))
    dealt = dealt.withColumn("__next_sketch", F.lead(F.col("__tree.sketch")).over(order)).filter(~F.col("__end"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    out = dealt.select("doc_id", n.cast("long").alias("n_chars"), "__tree", "__next_sketch", F.concat(F.left("text", n - half), F.left("__next", half)).alias("edited"))
    out = out.withColumn("__edited", tree(F.col("edited")))
    where = located(F.col("__tree"), F.col("__edited"))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("__tree")).alias("fingerprint"),
        fingerprint(F.col("__edited")).alias("edited_fingerprint"),
        likeness(F.col("__tree.sketch"), F.col("__edited.sketch")).alias("near_edited"),
        likeness(F.col("__tree.sketch"), F.col("__next_sketch")).alias("near_next"),
        F.size("__tree.paragraphs").cast("long").alias("n_paragraphs"),
        F.size(where).cast("long").alias("changed_paragraphs"),
        F.get(where, F.lit(0)).cast("long").alias("first_changed"),
    )


def compare_trees(docs: DataFrame) -> DataFrame:
    """As compare_edits, from all hashes of the trees."""
    dealt, order = with_next(docs)
    dealt = dealt.withColumn("__next", F.lead("text").over(order)).filter(~F.col("__end"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    out = dealt.select("doc_id", n.cast("long").alias("n_chars"), "__next", whole_tree(F.col("text")).alias("__tree"), F.concat(F.left("text", n - half), F.left("__next", half)).alias("edited"))
    out = out.withColumn("__edited", whole_tree(F.col("edited"))).withColumn("__after", whole_tree(F.col("__next")))
    where = located(F.col("__tree"), F.col("__edited"))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        whole_fingerprint(F.col("__tree")).alias("fingerprint"),
        whole_fingerprint(F.col("__edited")).alias("edited_fingerprint"),
        shared(F.col("__tree"), F.col("__edited")).alias("near_edited"),
        shared(F.col("__tree"), F.col("__after")).alias("near_next"),
        F.size("__tree.paragraphs").cast("long").alias("n_paragraphs"),
        F.size(where).cast("long").alias("changed_paragraphs"),
        F.get(where, F.lit(0)).cast("long").alias("first_changed"),
    )


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, '')) AS rn, count(*) OVER () AS n FROM documents
), e AS (
  SELECT a.doc_id, a.text, b.text AS nxt, left(a.text, length(a.text) - length(a.text) // 2) || left(b.text, length(a.text) // 2) AS edited
  FROM d a JOIN d b ON b.rn = a.rn % a.n + 1
), l AS (
  SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, list_transform([text, edited, nxt], lambda t: list_transform(string_split(t, chr(10)), lambda p: list_transform(range(0, (len(string_split(p, ' ')) - 1) // {LEAF} + 1), lambda i: md5(array_to_string(string_split(p, ' ')[i * {LEAF} + 1 : i * {LEAF} + {LEAF}], ' '))))) AS leaves
  FROM e
), p AS (
  SELECT *, list_transform(leaves, lambda f: list_transform(f, lambda x: sha256(array_to_string(x, '')))) AS pars,
    list_transform(leaves, lambda f: list_sort(list_distinct(list_transform(flatten(f), lambda x: left(x, 8))))[1:{SKETCH}]) AS sketch
  FROM l
), s AS (
  SELECT *, list_transform(pars, lambda q: sha256(array_to_string(list_transform(range(0, (len(q) - 1) // {SECTION} + 1), lambda i: sha256(array_to_string(q[i * {SECTION} + 1 : i * {SECTION} + {SECTION}], ''))), ''))) AS root,
    list_filter(range(0, greatest(len(pars[1]), len(pars[2]))), lambda i: pars[1][i + 1] IS DISTINCT FROM pars[2][i + 1]) AS changed,
    list_sort(list_distinct(list_concat(sketch[1], sketch[2])))[1:{SKETCH}] AS u2,
    list_sort(list_distinct(list_concat(sketch[1], sketch[3])))[1:{SKETCH}] AS u3
  FROM p
)
SELECT doc_id, n_chars, edited_sha256, root[1] || ':' || array_to_string(sketch[1], '') AS fingerprint, root[2] || ':' || array_to_string(sketch[2], '') AS edited_fingerprint,
  len(list_filter(u2, lambda x: list_contains(sketch[1], x) AND list_contains(sketch[2], x))) / len(u2) AS near_edited,
  len(list_filter(u3, lambda x: list_contains(sketch[1], x) AND list_contains(sketch[3], x))) / len(u3) AS near_next,
  len(pars[1]) AS n_paragraphs, len(changed) AS changed_paragraphs, changed[1] AS first_changed
FROM s
"""

TREES = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, '')) AS rn, count(*) OVER () AS n FROM documents
), e AS (
  SELECT a.doc_id, a.text, b.text AS nxt, left(a.text, length(a.text) - length(a.text) // 2) || left(b.text, length(a.text) // 2) AS edited
  FROM d a JOIN d b ON b.rn = a.rn % a.n + 1
), l AS (
  SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, list_transform([text, edited, nxt], lambda t: list_transform(string_split(t, chr(10)), lambda p: list_transform(range(0, (len(string_split(p, ' ')) - 1) // {LEAF} + 1), lambda i: md5(array_to_string(string_split(p, ' ')[i * {LEAF} + 1 : i * {LEAF} + {LEAF}], ' '))))) AS leaves
  FROM e
), p AS (
  SELECT *, list_transform(leaves, lambda f: list_transform(f, lambda x: sha256(array_to_string(x, '')))) AS pars, list_transform(leaves, lambda f: list_distinct(flatten(f))) AS own
  FROM l
), s AS (
  SELECT *, list_transform(pars, lambda q: list_transform(range(0, (len(q) - 1) // {SECTION} + 1), lambda i: sha256(array_to_string(q[i * {SECTION} + 1 : i * {SECTION} + {SECTION}], '')))) AS secs,
    list_filter(range(0, greatest(len(pars[1]), len(pars[2]))), lambda i: pars[1][i + 1] IS DISTINCT FROM pars[2][i + 1]) AS changed
  FROM p
)
SELECT doc_id, n_chars, edited_sha256,
  sha256(array_to_string(secs[1], '')) || ':' || array_to_string(secs[1], '') || ':' || array_to_string(pars[1], '') AS fingerprint,
  sha256(array_to_string(secs[2], '')) || ':' || array_to_string(secs[2], '') || ':' || array_to_string(pars[2], '') AS edited_fingerprint,
  len(list_intersect(own[1], own[2])) / len(list_distinct(list_concat(own[1], own[2]))) AS near_edited,
  len(list_intersect(own[1], own[3])) / len(list_distinct(list_concat(own[1], own[3]))) AS near_next,
  len(pars[1]) AS n_paragraphs, len(changed) AS changed_paragraphs, changed[1] AS first_changed
FROM s
"""
