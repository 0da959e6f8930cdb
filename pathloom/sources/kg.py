"""Knowledge graphs as tables: raw and canonical edges, both directions, node texts and a store on disk."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .durable import durable

# The eighteen relations of the biomedical graph in the order of their ids, with the descriptions that relation scoring reads.
BIOMEDICAL_RELATIONS = [
    ("ppi", "A protein-protein interaction where one gene/protein physically binds to, interacts with, or functionally associates with another gene/protein. This gene/protein has a direct molecular interaction with another gene/protein."),
    ("carrier", "A gene/protein acts as a carrier for a drug, meaning the protein transports or carries the drug molecule within the body. The drug is carried, bound, or transported by this gene/protein for distribution."),
    ("enzyme", "A gene/protein acts as an enzyme that metabolizes, catalyzes the breakdown of, or biochemically transforms a drug. The drug is metabolized, processed, or biotransformed by this enzyme."),
    ("target", "A drug targets, acts on, or modulates a specific gene/protein to exert its therapeutic or pharmacological effect. The gene/protein is the molecular target, receptor, or site of action of the drug."),
    ("transporter", "A gene/protein acts as a transporter that actively moves a drug across cell membranes, mediating the drug uptake, efflux, absorption, or excretion. The drug is transported into or out of cells by this transporter protein."),
    ("contraindication", "A drug is contraindicated for a disease, meaning the drug should not be used, is unsafe, or is not recommended for patients with this disease or condition."),
    ("indication", "A drug is indicated for treating, managing, or preventing a disease. The drug is prescribed, recommended, approved, or used therapeutically for this condition."),
    ("off-label use", "A drug is used off-label for a disease, meaning the drug is used to treat a condition for which it is not officially approved but has evidence of clinical benefit."),
    ("synergistic interaction", "Two drugs have a synergistic interaction, meaning they enhance each others therapeutic effect when used together. The combined effect is greater than the sum of their individual effects."),
    ("associated with", "A gene/protein is associated with a disease or an effect/phenotype, meaning the gene/protein plays a role in, contributes to, is implicated in, or is linked to the pathology of the disease or the manifestation of the phenotype."),
    ("parent-child", "A hierarchical ontological relationship where one entity is a parent category (broader concept) and the other is a child (narrower, more specific subtype). The child entity is a subtype of or belongs to the parent entity."),
    ("phenotype absent", "A disease does NOT present, exhibit, or manifest a specific effect/phenotype. Patients with this disease typically do not show this symptom, sign, or phenotypic feature."),
    ("phenotype present", "A disease presents, exhibits, or manifests a specific effect/phenotype. Patients with this disease typically show this symptom, sign, clinical feature, or phenotypic manifestation."),
    ("side effect", "A drug causes, induces, or is associated with an adverse effect/phenotype as a side effect. The effect/phenotype is an unwanted, unintended, or adverse reaction that occurs when taking this drug."),
    ("interacts with", "A gene/protein functionally interacts with, participates in, or is involved in a biological process, pathway, cellular component, molecular function, or exposure. Also covers interactions between biological processes, cellular components, molecular functions, and exposures."),
    ("linked to", "A disease is epidemiologically or causally linked to an environmental or lifestyle exposure. The exposure is a risk factor, contributing factor, or causative agent associated with the disease."),
    ("expression present", "A gene/protein is expressed in, actively produced in, or found in a specific anatomical structure or tissue. The anatomy is a site where this gene/protein is expressed, transcribed, or translated."),
    ("expression absent", "A gene/protein is NOT expressed in, not detected in, or absent from a specific anatomical structure or tissue. The anatomy is a site where this gene/protein is not found or not actively produced."),
]

#: Characters of a description, at most.
TEXT_LIMIT = 3000


@dataclass(frozen=True)
class Fields:
    """Detail fields that describe a node of one type: all of `primary` that fit, else the first real one of `fallback`."""

    primary: tuple[str, ...]
    fallback: tuple[str, ...] = ()


# Which detail fields describe the nodes of each type, most telling first.
BIOMEDICAL_FIELDS = {
    "drug": Fields(("description", "mechanism_of_action", "indication"), ("pharmacodynamics", "category", "group")),
    "gene/protein": Fields(("summary",), ("name",)),
    "disease": Fields(("mondo_definition", "umls_description", "orphanet_clinical_description"), ("mayo_symptoms", "orphanet_definition", "mondo_name")),
    "pathway": Fields(("summation",), ("displayName",)),
}


def relations(spark: SparkSession, named: list[tuple[str, str]] = BIOMEDICAL_RELATIONS) -> DataFrame:
    return spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(named)], "rel_id int, relation string, description string")


def undirected(edges: DataFrame) -> DataFrame:
    """u <= v and rel_id of each edge, as often as it is there: for what doesn't count edges."""
    return edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), "rel_id").where("u is not null and v is not null")


def canonical(edges: DataFrame) -> DataFrame:
    """Undirected distinct edges (u <= v, rel_id); parallel edges of other relations and loops stay."""
    return undirected(edges).distinct()


def both_ways(edges: DataFrame, *more: str) -> DataFrame:
    """node, other, rel_id and further columns: each edge from either end, a loop once."""
    there = edges.select(F.col("u").alias("node"), F.col("v").alias("other"), "rel_id", *more)
    back = edges.where("u <> v").select(F.col("v").alias("node"), F.col("u").alias("other"), "rel_id", *more)
    return there.unionByName(back)


def degrees(edges: DataFrame) -> DataFrame:
    """Edge ends at each node; a loop has two."""
    return edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def node_relations(edges: DataFrame) -> DataFrame:
    """node and relations: the sorted ids of the relations at it."""
    return both_ways(edges).groupBy("node").agg(F.sort_array(F.collect_set("rel_id")).alias("relations"))


def relation_target_types(adjacency: DataFrame, nodes: DataFrame, relations: DataFrame, most: int = 50) -> DataFrame:
    """node, relation and types: the sorted types of the first `most` neighbours (by id) along each relation of a node. adjacency: node, other, rel_id, which may repeat. nodes: node_id, type.

    Neighbours are counted by type first. Where they are few, or all of one type, which are first doesn't matter; only the others are put in order.
    """
    kind = nodes.select(F.col("node_id").alias("other"), F.col("type").alias("other_type"))
    typed = adjacency.join(kind.hint("shuffle_hash"), "other").select("node", "rel_id", "other", "other_type")  # edges need not be sorted to get a type
    counted = typed.repartition("node").groupBy("node", "rel_id", "other_type").agg(F.count("*").alias("n"))
    found = durable(counted.groupBy("node", "rel_id").agg(F.sort_array(F.collect_set("other_type")).alias("types"), F.sum("n").alias("n")), "types")
    many = (F.col("n") > most) & (F.size("types") > 1)
    known, mixed = found.where(~many), found.where(many).select("node", "rel_id")
    own = adjacency.join(mixed, ["node", "rel_id"], "left_semi").join(kind, "other")
    # repeated edges share a place
    first = own.withColumn("_n", F.dense_rank().over(Window.partitionBy("node", "rel_id").orderBy("other"))).where(F.col("_n") <= most)
    rest = first.groupBy("node", "rel_id").agg(F.sort_array(F.collect_set("other_type")).alias("types"))
    every = known.select("node", "rel_id", "types").unionByName(rest) if not mixed.isEmpty() else known
    return every.join(F.broadcast(relations.select("rel_id", "relation")), "rel_id").select("node", "relation", "types")  # a schema's relations


def shown_name(name: Column | str, node_id: Column | str) -> Column:
    return F.coalesce(name, F.concat(F.lit("Node_"), node_id))


def is_real(value: Column) -> Column:
    return F.coalesce((F.length(F.trim(value)) > 5) & ~F.lower(F.trim(value)).isin("nan", "none"), F.lit(False))


def described(node_type: Column | str, details: Column | str, fields: dict[str, Fields] = BIOMEDICAL_FIELDS, limit: int = TEXT_LIMIT) -> Column:
    """Real primary fields joined by spaces, up to the first that would pass the limit; else the first real fallback, cut to the limit; '' for other types."""
    details = F.col(details) if isinstance(details, str) else details
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def add(acc: Column, value: Column) -> Column:
        value = F.trim(value)
        full = acc["full"] | (acc["used"] + F.length(value) > limit)
        text = F.when(full, acc["text"]).when(acc["used"] == 0, value).otherwise(F.concat(acc["text"], F.lit(" "), value))
        return F.struct(text.alias("text"), F.when(full, acc["used"]).otherwise(acc["used"] + F.length(value)).alias("used"), full.alias("full"))

    out = F.lit("")
    for name, own in fields.items():
        real = lambda keys: F.filter(F.array(*[F.element_at(details, F.lit(k)) for k in keys]), is_real)
        text = F.aggregate(real(own.primary), start, add, lambda acc: acc["text"])
        if own.fallback:
            text = F.when(text != "", text).otherwise(F.coalesce(F.substring(F.trim(F.get(real(own.fallback), F.lit(0))), 1, limit), F.lit("")))
        out = F.when(node_type == name if isinstance(node_type, Column) else F.col(node_type) == name, text).otherwise(out)
    return out


def described_cumulatively(node_type: Column | str, details: Column | str, fields: dict[str, Fields] = BIOMEDICAL_FIELDS, limit: int = TEXT_LIMIT) -> Column:
    """All fields of the type joined by spaces, each cut to what is left of the limit (spaces don't count); '' for other types."""
    details = F.col(details) if isinstance(details, str) else details
    node_type = F.col(node_type) if isinstance(node_type, str) else node_type
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("used"))

    def add(acc: Column, value: Column) -> Column:
        part = F.substring(value, F.lit(1), F.lit(limit) - acc["used"])
        fits = (acc["used"] < limit) & (F.length(value) > 0)
        return F.struct(F.when(fits, F.array_append(acc["parts"], part)).otherwise(acc["parts"]).alias("parts"), F.when(fits, acc["used"] + F.length(part)).otherwise(acc["used"]).alias("used"))

    out = F.lit("")
    for name, own in fields.items():
        values = F.filter(F.array(*[F.element_at(details, F.lit(k)) for k in (*own.primary, *own.fallback)]), lambda v: v.isNotNull())
        out = F.when(node_type == name, F.array_join(F.aggregate(values, start, add, lambda acc: acc["parts"]), " ")).otherwise(out)
    return out


def node_text(name: Column | str, description: Column) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return F.when(description != "", F.concat(name, F.lit(". "), description)).otherwise(name)


@dataclass
class Store:
    """Nodes, edges (canonical), relations, node texts and, from either end, the neighbours of a graph, kept as Parquet under one folder.

    Neighbours are bucketed and sorted by node. neighbours() tells the planner so, so a frontier meets them without moving them.
    """

    spark: SparkSession
    folder: str

    TABLES = ("nodes", "edges", "relations", "neighbours")
    #: Buckets of a store's neighbours.
    BUCKETS = 32

    def complete(self, table: str) -> bool:
        """Whether a table was written to its end, asked of the store's own file system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def ensure(self, nodes: DataFrame, edges: DataFrame, relations: DataFrame, fields: dict[str, Fields] = BIOMEDICAL_FIELDS) -> Store:
        """Write what is not there yet. Isolated nodes beyond the largest edge end stay: existence is by the nodes table."""
        named = nodes.withColumn("name", shown_name("name", "node_id"))
        made = {
            "nodes": named.withColumn("text", node_text("name", described("type", "details", fields))),
            "edges": canonical(edges).repartition("u").sortWithinPartitions("u"),
            "relations": relations,
        }
        for table, df in made.items():
            if not self.complete(table):
                df.write.mode("overwrite").parquet(f"{self.folder}/{table}")
        if not self.complete("neighbours"):
            both = both_ways(self.read("edges")).join(self.read("nodes").select(F.col("node_id").alias("other"), F.col("type").alias("other_type")), "other")
            both = both.join(F.broadcast(self.read("relations").select("rel_id", "relation")), "rel_id")  # a schema's relations
            out = both.select("node", "other", "rel_id", "relation", "other_type").repartition(self.BUCKETS, "node")
            out.write.mode("overwrite").format("parquet").bucketBy(self.BUCKETS, "node").sortBy("node").option("path", f"{self.folder}/neighbours").saveAsTable(self._table())
        return self

    def _table(self) -> str:
        """The session's name for this store's neighbours."""
        return "pathloom_neighbours_" + hashlib.md5(self.folder.encode(), usedforsecurity=False).hexdigest()

    def neighbours(self) -> DataFrame:
        """node, other, rel_id, relation and other_type of every edge from either end, with its layout known."""
        if not self.spark.catalog.tableExists(self._table()):
            columns = ", ".join(f"`{c}` {t}" for c, t in self.read("neighbours").dtypes)
            self.spark.sql(f"CREATE TABLE {self._table()} ({columns}) USING parquet CLUSTERED BY (node) SORTED BY (node) INTO {self.BUCKETS} BUCKETS LOCATION '{self.folder}/neighbours'")
        return self.spark.table(self._table())

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}")


# ---- A typed graph over the benchmark tables ---------------------------------------------------------------------

TYPES = ("region", "nation", "customer", "supplier", "part", "order", "brand", "segment")
RELATIONS = [
    ("in_region", "A nation lies in a region."), ("lives_in", "A customer lives in a nation."), ("based_in", "A supplier is based in a nation."),
    ("in_segment", "A customer belongs to a market segment."), ("placed", "A customer placed an order."), ("contains", "An order contains a part."),
    ("shipped_by", "An order was shipped by a supplier."), ("supplied_by", "A part is supplied by a supplier."), ("has_brand", "A part carries a brand."),
]
#: Node ids are the type's place in TYPES times this, plus the key.
STRIDE = 1_000_000_000
COMMERCE_FIELDS = {"part": Fields(("p_name", "p_type"), ("p_brand",)), "nation": Fields(("n_name",)), "customer": Fields(("c_mktsegment",), ("c_name",)), "order": Fields(("o_orderpriority", "o_orderstatus"))}


def _id(kind: str, key: str) -> Column:
    return F.lit(TYPES.index(kind)).cast("bigint") * STRIDE + F.expr(key).cast("bigint")


def commerce(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """nodes(node_id, name, type, details) and edges(src, dst, rel_id) over the tables of sf_dir.

    Brands are keyed by their number; segments by their place in the alphabet among the segments (a handful).
    """
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    names = t["customer"].select("c_mktsegment").distinct()
    segments = names.join(F.broadcast(names.toDF("earlier")), F.expr("earlier < c_mktsegment"), "left").groupBy("c_mktsegment").agg(F.count("earlier").alias("segment"))
    brand = "cast(substring(p_brand, 7) as bigint)"
    details = lambda *names: F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))]) if names else F.lit(None).cast("map<string,string>")

    def node(df: DataFrame, kind: str, key: str, name: str, *own: str) -> DataFrame:
        return df.select(_id(kind, key).alias("node_id"), F.expr(name).alias("name"), F.lit(kind).alias("type"), details(*own).alias("details"))

    nodes = [
        node(t["region"], "region", "r_regionkey", "r_name"), node(t["nation"], "nation", "n_nationkey", "n_name", "n_name"),
        node(t["customer"], "customer", "c_custkey", "c_name", "c_mktsegment", "c_name"), node(t["supplier"], "supplier", "s_suppkey", "s_name"),
        node(t["part"], "part", "p_partkey", "p_name", "p_name", "p_type", "p_brand"), node(t["orders"], "order", "o_orderkey", "concat('Order#', o_orderkey)", "o_orderpriority", "o_orderstatus"),
        node(t["part"].select("p_brand").distinct(), "brand", brand, "p_brand"), node(segments, "segment", "segment", "c_mktsegment"),
    ]

    def edge(df: DataFrame, relation: str, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
        return df.select(_id(*a).alias("src"), _id(*b).alias("dst"), F.lit([r for r, _ in RELATIONS].index(relation)).alias("rel_id"))

    lines = t["lineitem"]
    edges = [
        edge(t["nation"], "in_region", ("nation", "n_nationkey"), ("region", "n_regionkey")), edge(t["customer"], "lives_in", ("customer", "c_custkey"), ("nation", "c_nationkey")),
        edge(t["supplier"], "based_in", ("supplier", "s_suppkey"), ("nation", "s_nationkey")),
        edge(t["customer"].join(F.broadcast(segments), "c_mktsegment"), "in_segment", ("customer", "c_custkey"), ("segment", "segment")),
        edge(t["orders"], "placed", ("customer", "o_custkey"), ("order", "o_orderkey")), edge(lines, "contains", ("order", "l_orderkey"), ("part", "l_partkey")),
        edge(lines, "shipped_by", ("order", "l_orderkey"), ("supplier", "l_suppkey")), edge(lines, "supplied_by", ("part", "l_partkey"), ("supplier", "l_suppkey")),
        edge(t["part"], "has_brand", ("part", "p_partkey"), ("brand", brand)),
    ]
    union = lambda frames: frames[0] if len(frames) == 1 else union(frames[:-1]).unionByName(frames[-1])
    return union(nodes), union(edges)
