"""Structured look-ups as joins."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Collection, Container, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType

from tessera.functions import lexicon as L
from tessera.functions import text as T
from tessera.operators.references import filter_words
from tessera.session import checkpoint, shuffle_partitions

# Columns of a table-row store that are returned, and those that are searched, as far as they exist.
ROW_COLUMNS = ("chunk_id", "source", "doc_name", "page", "section", "section_path", "table_id", "row_id", "row_index", "headers", "header", "parameter_name", "text", "content", "row_text", "model", "version")
SEARCHED = ("headers", "header", "parameter_name", "text", "content", "row_text", "source", "doc_name")


def lookup_codes(queries: DataFrame, codes: DataFrame) -> DataFrame:
    """The first record (by ``no``) of each query's code: an equi-join on the normalised code.

    ``queries``: ``query_id, code, model``; ``codes``: ``no, code, model, ...``. A record of no model fits any. A query
    without a code or a match is left out."""
    left = queries.where("code is not null").select("query_id", T.normal_code(F.col("code")).alias("_c"), F.coalesce("model", F.lit("")).alias("_m"))
    right = codes.withColumn("_c", T.normal_code(F.col("code"))).withColumn("_own", F.coalesce("model", F.lit("")))
    joined = left.join(right, "_c").where((F.col("_own") == "") | (F.col("_own") == F.col("_m")))
    rest = [c for c in codes.columns]
    return joined.groupBy("query_id").agg(F.min_by(F.struct(*rest), "no").alias("_r")).select("query_id", "_r.*")


#: Names that are sent to all workers at most; more are joined by a shuffle.
SENT_NAMES = 200_000
#: Characters at the beginning of a name by which places in texts are chosen.
HEAD = 3
#: Sets of nodes that are sent to all workers at most, each with its few relations; more are joined by a shuffle.
SENT_SETS = 10_000
#: Texts of which one task writes the relations.
TASK_TEXTS = 20_000


class _Sieve:
    """Names as two bits each of a Bloom filter of bounded size, built by Spark: all that are in it pass, and a few others."""

    def __init__(self, names: DataFrame):
        words = filter_words(names.count())
        self.last = 64 * words - 1
        code = F.crc32(F.col("_n").cast("binary"))
        places = names.select(F.explode(F.array(code.bitwiseAND(F.lit(self.last)), F.shiftright(code, 7).bitwiseAND(F.lit(self.last)))).alias("_p"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_p").bitwiseAND(F.lit(63)).cast("int"))
        filled = places.groupBy(F.shiftright("_p", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
        bits = np.zeros(words, "<i8")
        bits[filled["word"].to_numpy()] = filled["bits"].to_numpy()
        self.bits = bits.tobytes()

    def __contains__(self, name: str) -> bool:
        code = zlib.crc32(name.encode())
        a, b = code & self.last, code >> 7 & self.last
        return bool(self.bits[a >> 3] >> (a & 7) & self.bits[b >> 3] >> (b & 7) & 1)


class _Names:
    """Names by their beginnings. At a place of a text only names of the lengths that its beginning has can stand, so a
    place costs a look-up for each such length, however many names begin alike."""

    def __init__(self, lengths: dict[str, tuple[int, ...]], names: Container[str]):
        self.lengths, self.names = lengths, names
        self.short = any(len(g) < HEAD for g in lengths)

    @classmethod
    def of(cls, names: Collection[str]) -> _Names:
        lengths = defaultdict(set)
        for n in names:
            lengths[n[:HEAD]].add(len(n))
        return cls({g: tuple(x) for g, x in lengths.items()}, names)

    def places(self, text: str) -> Iterator[tuple[int, tuple[int, ...]]]:
        """Where a name may begin, with the lengths it may have. A few beginnings are looked for in the text, for more each
        place of the text is looked up."""
        lengths = self.lengths
        if 2 * len(lengths) <= len(text):
            for g, sizes in lengths.items():
                i = text.find(g)
                while i >= 0:
                    yield i, sizes
                    i = text.find(g, i + 1)
            return
        for i in range(len(text)):
            for size in range(1 if self.short else HEAD, HEAD + 1):
                if len(g := text[i : i + size]) == size and (sizes := lengths.get(g)):
                    yield i, sizes

    def inside(self, text: str) -> set[str]:
        names = self.names
        return {x for i, sizes in self.places(text) for n in sizes if (x := text[i : i + n]) in names}


def _inside(spark: SparkSession, names: _Names):
    """A column function: the distinct ones of ``names`` that a text contains. Both are in lower case."""
    sent = spark.sparkContext.broadcast(names)

    @F.arrow_udf("array<string>")
    def work(texts: pa.Array) -> pa.Array:
        inside = sent.value.inside
        return pa.array([None if t is None else list(inside(t)) for t in texts.to_pylist()], pa.list_(pa.string()))

    return work


def _inside_ids(spark: SparkSession, names: dict[str, list], kind: DataType):
    """A column function: what ``names`` has for those of them that a text contains, which may repeat. Names and texts are in
    lower case."""
    sent, item = spark.sparkContext.broadcast(_Names.of(names)), to_arrow_type(kind)

    @F.arrow_udf(ArrayType(kind))
    def work(texts: pa.Array) -> pa.Array:
        inside, ids = sent.value.inside, sent.value.names
        return pa.array([None if t is None else [x for n in inside(t) for x in ids[n]] for t in texts.to_pylist()], pa.list_(item))

    return work


def _parts(texts: DataFrame, names: DataFrame, exact: bool = True) -> DataFrame:
    """The columns of ``texts`` but ``_t``, and a row for each different name ``_n`` of ``names`` that ``_t`` contains. Both are in
    lower case. Without ``exact`` other parts of ``_t`` may be among them, and they have met no names in a shuffle."""
    keep = [c for c in texts.columns if c != "_t"]
    names = names.select("_n").where("_n != ''").distinct()
    sent = [r["_n"] for r in names.limit(SENT_NAMES + 1).collect()]
    if len(sent) <= SENT_NAMES:
        return texts.select(*keep, F.explode(_inside(texts.sparkSession, _Names.of(frozenset(sent)))(F.col("_t"))).alias("_n"))
    names = checkpoint(names)
    lengths = names.groupBy(F.substring("_n", 1, HEAD).alias("_g")).agg(F.collect_set(F.length("_n")).alias("_sizes"))
    heads = {r["_g"]: tuple(r["_sizes"]) for r in lengths.limit(SENT_NAMES + 1).collect()}
    if len(heads) <= SENT_NAMES:
        parts = texts.select(*keep, F.explode(_inside(texts.sparkSession, _Names(heads, _Sieve(names)))(F.col("_t"))).alias("_n"))
        return parts.join(names, "_n").select(*keep, "_n") if exact else parts.select(*keep, "_n")
    sizes = names.agg(F.array_sort(F.collect_set(F.least(F.length("_n"), F.lit(HEAD))))).first()[0]
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.length("_t")), lambda i: F.struct(i.alias("i"), F.substr(F.col("_t"), i, F.lit(n)).alias("g")))
    places = texts.where("_t != ''").select(*keep, "_t", F.explode(F.concat(*[grams(n) for n in sizes])).alias("_p")).select(*keep, "_t", F.col("_p.i").alias("_i"), F.col("_p.g").alias("_g"))
    parts = places.join(lengths, "_g").select(*keep, F.explode(F.transform("_sizes", lambda n: F.substr(F.col("_t"), F.col("_i"), n))).alias("_n")).distinct()
    return parts.join(names, "_n").select(*keep, "_n")


def names_contained(texts: DataFrame, names: DataFrame) -> DataFrame:
    """All names that each text contains, without regard to case: ``text_id, name_id, name``, distinct.

    ``texts``: ``text_id, text``; ``names``: ``name_id, name`` (a row for each alias). At each place of a text only the parts
    that are as long as a name of the same first three characters are looked up, as whole names, so work doesn't grow with
    the number of names that begin alike. Up to ``SENT_NAMES`` different names are sent to the texts, which then take part in
    no shuffle; of more a Bloom filter is sent, and the parts of texts that pass it meet them by an equi-join. Empty and null names and texts match nothing."""
    low = names.select("name_id", "name", F.lower("name").alias("_n")).where("_n != ''").distinct()
    hits = _parts(texts.select("text_id", F.lower("text").alias("_t")), low)
    return hits.join(low, "_n").select("text_id", "name_id", "name").distinct()


def names_in_texts(texts: DataFrame, names: DataFrame) -> DataFrame:
    """The longest name that each text contains (``names_contained``): ``text_id, name_id, name``; the first ``name_id`` among
    equals. A text without a match is left out."""
    best = F.max_by(F.struct("name_id", "name"), F.struct(F.length("name"), -F.col("name_id")))
    return names_contained(texts, names).groupBy("text_id").agg(best.alias("b")).select("text_id", "b.name_id", "b.name")


def names_like(queries: DataFrame, names: DataFrame) -> DataFrame:
    """The first name, by ``name_id``, that contains each query's whole text, without regard to case: ``query_id, name_id, name``.

    ``queries``: ``query_id, text``. The look-up of ``names_contained`` with the sides changed, so a name of any length is found;
    blank queries match nothing."""
    asked = queries.select(F.col("query_id").alias("name_id"), T.strip(F.col("text")).alias("name"))
    hits = names_contained(names.select(F.struct("name_id", "name").alias("text_id"), F.col("name").alias("text")), asked)
    first = hits.groupBy(F.col("name_id").alias("query_id")).agg(F.min(F.struct("text_id.name_id", "text_id.name")).alias("b"))
    return first.select("query_id", "b.name_id", "b.name")


def lookup_parameters(queries: DataFrame, parameters: DataFrame) -> DataFrame:
    """Each query's parameter: the longest whose name or alias its text contains, else the first whose name or alias contains
    its whole text: ``query_id, found, way, parameter_id``. ``way`` is ``in text``, ``like`` or null.

    ``queries``: ``query_id, text, model``; ``parameters``: ``parameter_id`` (a whole number, in order of record), ``name,
    aliases, model``. A record of no model fits any."""
    named = parameters.select("parameter_id", F.coalesce("model", F.lit("")).alias("_own"), F.explode(F.array_union(F.array("name"), F.coalesce("aliases", T.strings(())))).alias("name"))
    fits = lambda df: df.join(queries.select("query_id", F.coalesce("model", F.lit("")).alias("_m")), "query_id").join(named.select(F.col("parameter_id").alias("name_id"), "_own").distinct(), "name_id").where((F.col("_own") == "") | (F.col("_own") == F.col("_m")))
    names = named.select(F.col("parameter_id").alias("name_id"), "name")
    inside = fits(names_contained(queries.select(F.col("query_id").alias("text_id"), "text"), names).withColumnRenamed("text_id", "query_id"))
    best = inside.groupBy("query_id").agg(F.max_by("name_id", F.struct(F.length("name"), -F.col("name_id"))).alias("p"))
    asked = queries.select(F.col("query_id").alias("name_id"), T.strip(F.col("text")).alias("name"))
    like = fits(names_contained(names.select(F.struct("name_id").alias("text_id"), F.col("name").alias("text")), asked).select(F.col("name_id").alias("query_id"), F.col("text_id.name_id").alias("name_id")))
    spare = like.groupBy("query_id").agg(F.min("name_id").alias("l"))
    rows = queries.select("query_id").join(best, "query_id", "left").join(spare, "query_id", "left")
    way = F.when(F.col("p").isNotNull(), "in text").when(F.col("l").isNotNull(), "like")
    return rows.select("query_id", way.isNotNull().alias("found"), way.alias("way"), F.coalesce("p", "l").alias("parameter_id"))


def lookup_rows(queries: DataFrame, rows: DataFrame, limit: int = 5, order: str = "chunk_id") -> DataFrame:
    """Rows of a table-row store that contain a term of a query in any of the known columns: ``query_id, place`` and the columns of
    ``ROW_COLUMNS`` that the store has; the first ``limit`` (1 to 20) by ``order``.

    ``queries``: ``query_id, query, model``. ``model`` matches rows of it or of none, a version in the query has to be in the row's.
    A blank or null query finds every row that fits.
    Terms are looked for as in ``names_contained``, each once for all queries. A term in which another one of its query stands
    finds no more than that one, and a query whose version no row has finds nothing, so neither is looked for. Only a term's
    first ``limit`` rows of each model, and of each version that is asked for with it, can be a query's first ones, so no more
    meet the queries; only keys take part until the best are known."""
    columns = [c for c in ROW_COLUMNS if c in rows.columns]
    searched = [c for c in SEARCHED if c in rows.columns]
    most = min(max(limit, 1), 20)
    cell = lambda c: F.array_join(c, " ") if rows.schema[c].dataType.typeName() == "array" else F.col(c).cast("string")
    first = lambda df, *by: df.withColumn("_at", F.row_number().over(W.partitionBy(*by).orderBy(order))).where(F.col("_at") <= most).drop("_at")
    models = lambda c: F.when(c == "", F.array(F.lit("*"))).otherwise(F.array(F.concat(F.lit("="), c), F.lit("=")))
    version = F.lower(F.coalesce(F.col("version").cast("string"), F.lit(""))) if "version" in rows.columns else F.lit("")
    asked_version = F.lower(F.regexp_extract("query", L.ROW_VERSION, 0)) if "version" in rows.columns else F.lit("")
    terms = lambda t: F.filter(t, lambda x: ~F.exists(t, lambda y: (y != x) & F.contains(x, y)))
    once = checkpoint(rows.dropDuplicates([order]))
    facts = once.select(order, F.concat(F.lit("="), F.coalesce("model", F.lit("")) if "model" in rows.columns else F.lit("")).alias("_own"), version.alias("_version"), F.lower(F.concat_ws("\x00", *[cell(c) for c in searched])).alias("_t"))
    # the asked versions that are in each version of a row
    seen = facts.select(F.col("_version").alias("text_id"), F.col("_version").alias("text")).distinct()
    met = names_contained(seen, queries.select(asked_version.alias("name_id"), asked_version.alias("name")).distinct())
    met = checkpoint(met.select(F.col("text_id").alias("_version"), F.col("name_id").alias("_v")))
    had = met.select("_v").distinct().unionByName(queries.sparkSession.range(1).select(F.lit("").alias("_v")))
    within = met.groupBy("_version").agg(F.collect_set("_v").alias("_vs"))
    if met.count() <= SENT_NAMES:
        had, within = F.broadcast(had), F.broadcast(within)
    said = queries.select("query_id", models(F.coalesce("model", F.lit(""))).alias("_keys"), F.coalesce(asked_version, F.lit("")).alias("_v"), T.row_terms(F.coalesce("query", F.lit(""))).alias("_terms"))
    said = checkpoint(said.join(had, "_v", "left_semi").select("query_id", "_keys", "_v", terms(F.col("_terms")).alias("_terms")).distinct())
    asked = said.select("query_id", "_keys", "_v", F.explode("_terms").alias("_n"))
    hits = _parts(facts.join(within, "_version", "left").select(order, "_own", F.concat(T.strings(("",)), F.coalesce("_vs", T.strings(()))).alias("_vs"), "_t"), asked.select("_n"), exact=False)
    pairs = checkpoint(asked.select("_n", "_v").distinct())
    hits = hits.select(order, "_own", "_n", F.explode("_vs").alias("_v"))
    if pairs.count() <= SENT_NAMES:
        hits = first(hits.join(F.broadcast(pairs), ["_n", "_v"], "left_semi"), "_n", "_v", "_own")
    else:  # cut before they are shuffled; the checkpoint keeps Spark from moving the join below
        hits = checkpoint(first(hits, "_n", "_v", "_own")).join(pairs, ["_n", "_v"], "left_semi")
    hits = first(hits.select(order, "_n", "_v", F.explode(F.array("_own", F.lit("*"))).alias("_key")), "_n", "_v", "_key")
    good = asked.select("query_id", "_n", "_v", F.explode("_keys").alias("_key")).join(hits, ["_n", "_v", "_key"]).select("query_id", order)
    # a blank query takes the first rows of all that fit: of its model's and none's first ones, or of every model's
    blank = said.where(F.size("_terms") == 0).select("query_id", F.explode("_keys").alias("_key"))
    any_row = first(first(facts.select(order, "_own"), "_own").select(order, F.explode(F.array("_own", F.lit("*"))).alias("_key")), "_key")
    good = good.unionByName(blank.join(any_row, "_key").select("query_id", order)).distinct()
    place = F.row_number().over(W.partitionBy("query_id").orderBy(order))
    best = good.withColumn("place", place).where(F.col("place") <= most)
    return best.join(once.select(*columns), order).select("query_id", "place", *columns)


def by_ids(ids: DataFrame, docs: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Documents of id lists in their order: ``query_id, place, ...``; ``ids``: ``query_id, ids``. Unknown ids go."""
    return ids.select("query_id", F.posexplode("ids").alias("place", key)).join(docs, key)


def _first_named(texts: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of the ``name_id`` whose names each text contains: ``text_id, ids``; texts that contain none are left out.

    As ``names_contained``, but names are one with all their ids, of which no more than the first ``most`` can count."""
    low = names.select("name_id", F.lower("name").alias("_n")).where("_n != '' and name_id is not null").distinct()
    first = low.withColumn("_at", F.row_number().over(W.partitionBy("_n").orderBy("name_id"))).where(F.col("_at") <= most).groupBy("_n").agg(F.collect_list("name_id").alias("_ids"))
    sent = first.limit(SENT_NAMES + 1).collect()
    texts = texts.select("text_id", F.lower("text").alias("_t"))
    if len(sent) <= SENT_NAMES:
        ids = _inside_ids(texts.sparkSession, {r["_n"]: r["_ids"] for r in sent}, names.schema["name_id"].dataType)
        hits = texts.select("text_id", ids(F.col("_t")).alias("_ids"))  # not filtered here: Spark would look texts up for the filter and again
    else:
        first = checkpoint(first)
        hits = _parts(texts, first).join(first, "_n").select("text_id", "_ids")
    return hits.groupBy("text_id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_ids")))), 1, most).alias("ids")).where(F.size("ids") > 0)


def expand_graph(texts: DataFrame, nodes: DataFrame, edges: DataFrame, most_nodes: int = 4, most_edges: int = 12, most_terms: int = 8) -> tuple[DataFrame, DataFrame]:
    """One hop in a graph from the entities that texts name: the relations ``text_id, edge_id, source, relation, target``, and the
    texts' ``text_id, entities, terms``.

    ``texts``: ``text_id, text``; ``nodes``: ``node_id, label, aliases``; ``edges``: ``edge_id, source, relation, target``. A node is
    named if its label or an alias is in the text (``names_contained``); the first ``most_nodes`` by id count, and of their
    edges the first ``most_edges`` by id. So no more than that of a node's edges can count, and only these leave it, however
    many it has; texts that name the same nodes share one hop. A node without a label shows its id. ``terms`` are the labels
    of the relations, in order, that the text does not have. Up to ``SENT_SETS`` sets of nodes are sent to the texts with their
    relations; whole-row repeats of texts count once."""
    texts = texts.select("text_id", "text").distinct()
    names = nodes.select(F.col("node_id").alias("name_id"), F.explode(F.array_union(F.array("label"), F.coalesce("aliases", T.strings(())))).alias("name"))
    seeds = checkpoint(_first_named(texts, names, most_nodes).withColumnRenamed("ids", "entities"))
    once = edges.select("edge_id", "source", "relation", "target").distinct()
    ends = once.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("node"), F.struct("edge_id", "source", "relation", "target").alias("x"))
    first = ends.withColumn("_n", F.row_number().over(W.partitionBy("node").orderBy("x"))).where(F.col("_n") <= most_edges).select("node", "x")
    sets = seeds.select("entities").distinct()
    hop = sets.select("entities", F.explode("entities").alias("node")).join(first, "node").groupBy("entities").agg(F.slice(F.array_sort(F.collect_set("x")), 1, most_edges).alias("e"))
    label = lambda side: nodes.select(F.col("node_id").alias(side), F.col("label").alias(f"_{side}"))
    found = hop.select("entities", F.explode("e").alias("x")).select("entities", "x.*").join(label("source"), "source", "left").join(label("target"), "target", "left")
    shown = F.struct("edge_id", F.coalesce("_source", "source").alias("source"), "relation", F.coalesce("_target", "target").alias("target"))
    hops = checkpoint(found.groupBy("entities").agg(F.array_sort(F.collect_list(shown)).alias("e")))
    hops = F.broadcast(hops) if hops.count() <= SENT_SETS else hops
    # a few bytes of a text become many relations, so adaptive execution would leave all of them to one task
    tasks = min(shuffle_partitions(texts.sparkSession), 1 + seeds.count() // TASK_TEXTS)
    relations = seeds.repartition(tasks, "text_id").join(hops, "entities").select("text_id", F.explode("e").alias("x")).select("text_id", "x.*")
    said = F.array_distinct(F.flatten(F.transform("e", lambda x: F.array(x["source"], x["target"]))))
    terms = texts.select("text_id", F.lower("text").alias("_t")).join(seeds, "text_id").join(hops.select("entities", said.alias("said")), "entities", "left")
    new = F.slice(F.filter(F.coalesce("said", T.strings(())), lambda x: ~F.contains("_t", F.lower(x))), 1, most_terms)
    return relations, terms.select("text_id", "entities", new.alias("terms"))


def missing_gold(rows: DataFrame, docs: DataFrame, ids: str, key: str = "chunk_id") -> DataFrame:
    """Ids that rows list and no document has: ``id, chunk_id``."""
    listed = rows.select("id", F.explode(ids).alias(key)).where(F.col(key).isNotNull()).distinct()
    return listed.join(docs.select(key).distinct(), key, "left_anti").select("id", key)


def gathered_texts(rows: DataFrame, docs: DataFrame, ids: str, key: str = "chunk_id") -> DataFrame:
    """Texts of each row's ids, in their order, joined by line ends; unknown ids give empty lines: ``id, text``."""
    listed = rows.select("id", F.posexplode(ids).alias("place", key))
    joined = listed.join(docs.select(key, "text"), key, "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("text", F.lit("")).alias("text")))).alias("_t"))
    return joined.select("id", F.array_join(F.transform("_t", lambda x: x["text"]), "\n").alias("text"))


def refused_references(requests: DataFrame, docs: DataFrame, ids: str, key: str = "chunk_id") -> DataFrame:
    """Requests that name documents which don't exist, and these: ``id, unknown`` (sorted). Others may be saved."""
    return missing_gold(requests, docs, ids, key).groupBy("id").agg(F.array_sort(F.collect_set(key)).alias("unknown"))
