"""DuckDB SQL for the catalogue's queries, written from the operators' definitions."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# ---- The commerce graph ------------------------------------------------------------------------------------------

STRIDE = 1_000_000_000
GRAPH = f"""
segs AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS segment FROM (SELECT DISTINCT c_mktsegment FROM customer)),
nodes AS (
  SELECT CAST(r_regionkey AS BIGINT) AS node_id, r_name AS name, 'region' AS type FROM region
  UNION ALL SELECT {STRIDE} + n_nationkey, n_name, 'nation' FROM nation
  UNION ALL SELECT {2 * STRIDE} + c_custkey, c_name, 'customer' FROM customer
  UNION ALL SELECT {3 * STRIDE} + s_suppkey, s_name, 'supplier' FROM supplier
  UNION ALL SELECT {4 * STRIDE} + p_partkey, p_name, 'part' FROM part
  UNION ALL SELECT {5 * STRIDE} + o_orderkey, 'Order#' || o_orderkey, 'order' FROM orders
  UNION ALL SELECT DISTINCT {6 * STRIDE} + CAST(substr(p_brand, 7) AS BIGINT), p_brand, 'brand' FROM part
  UNION ALL SELECT {7 * STRIDE} + segment, c_mktsegment, 'segment' FROM segs
), raw AS (
  SELECT {STRIDE} + n_nationkey AS src, CAST(n_regionkey AS BIGINT) AS dst, 0 AS rel_id FROM nation
  UNION ALL SELECT {2 * STRIDE} + c_custkey, {STRIDE} + c_nationkey, 1 FROM customer
  UNION ALL SELECT {3 * STRIDE} + s_suppkey, {STRIDE} + s_nationkey, 2 FROM supplier
  UNION ALL SELECT {2 * STRIDE} + c_custkey, {7 * STRIDE} + segment, 3 FROM customer JOIN segs USING (c_mktsegment)
  UNION ALL SELECT {2 * STRIDE} + o_custkey, {5 * STRIDE} + o_orderkey, 4 FROM orders
  UNION ALL SELECT {5 * STRIDE} + l_orderkey, {4 * STRIDE} + l_partkey, 5 FROM lineitem
  UNION ALL SELECT {5 * STRIDE} + l_orderkey, {3 * STRIDE} + l_suppkey, 6 FROM lineitem
  UNION ALL SELECT {4 * STRIDE} + l_partkey, {3 * STRIDE} + l_suppkey, 7 FROM lineitem
  UNION ALL SELECT {4 * STRIDE} + p_partkey, {6 * STRIDE} + CAST(substr(p_brand, 7) AS BIGINT), 8 FROM part
), edges AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v, rel_id FROM raw),
rels(rel_id, relation, description) AS (VALUES (0, 'in_region', 'A nation lies in a region.'), (1, 'lives_in', 'A customer lives in a nation.'), (2, 'based_in', 'A supplier is based in a nation.'),
  (3, 'in_segment', 'A customer belongs to a market segment.'), (4, 'placed', 'A customer placed an order.'), (5, 'contains', 'An order contains a part.'),
  (6, 'shipped_by', 'An order was shipped by a supplier.'), (7, 'supplied_by', 'A part is supplied by a supplier.'), (8, 'has_brand', 'A part carries a brand.')),
adj AS (SELECT u AS node, v AS other, rel_id FROM edges UNION ALL SELECT v, u, rel_id FROM edges WHERE u <> v),
steps AS MATERIALIZED (SELECT adj.node, adj.other, rels.relation, n.type AS other_type FROM adj JOIN rels USING (rel_id) JOIN nodes n ON n.node_id = adj.other)
"""


def graph(select: str, *ctes: str, recursive: bool = False) -> str:
    return "WITH " + ("RECURSIVE " if recursive else "") + ",\n".join([GRAPH, *ctes]) + "\n" + select


ORACLES["kg_nodes"] = graph("SELECT node_id, name, type FROM nodes")
ORACLES["kg_edges_canonical"] = graph("SELECT u, v, rel_id FROM edges")
ORACLES["kg_degree"] = graph("SELECT node, count(*) AS degree FROM (SELECT u AS node FROM edges UNION ALL SELECT v FROM edges) GROUP BY node")
ORACLES["kg_node_relations"] = graph("SELECT node, string_agg(CAST(rel_id AS VARCHAR), ',' ORDER BY rel_id) AS relations FROM (SELECT DISTINCT node, rel_id FROM adj) GROUP BY node")
ORACLES["kg_rel_target_types"] = graph(
    "SELECT node, relation, string_agg(DISTINCT other_type, ',' ORDER BY other_type) AS types FROM (SELECT *, row_number() OVER (PARTITION BY node, relation ORDER BY other) AS n FROM steps) WHERE n <= 50 GROUP BY node, relation"
)
ORACLES["kg_store_roundtrip"] = graph("SELECT relation, count(*) AS edges, count(DISTINCT u) AS us, count(DISTINCT v) AS vs FROM edges JOIN rels USING (rel_id) GROUP BY relation")
ORACLES["neighbors_by_relation"] = graph(
    f"SELECT node, relation, other_type, count(*) AS n, min(other) AS first, max(other) AS last FROM steps WHERE node BETWEEN {STRIDE} AND {2 * STRIDE - 1} GROUP BY ALL"
)

REAL = "length(trim({0})) > 5 AND lower(trim({0})) NOT IN ('nan', 'none')"
_real = lambda c: f"CASE WHEN {REAL.format(c)} THEN trim({c}) END"
DESCRIBED = f"""
described AS (
  SELECT {4 * STRIDE} + p_partkey AS node_id, coalesce(nullif(concat_ws(' ', {_real("p_name")}, {_real("p_type")}), ''), {_real("p_brand")}, '') AS d, concat_ws(' ', p_name, p_type, p_brand) AS whole FROM part
  UNION ALL SELECT {STRIDE} + n_nationkey, coalesce({_real("n_name")}, ''), n_name FROM nation
  UNION ALL SELECT {2 * STRIDE} + c_custkey, coalesce({_real("c_mktsegment")}, {_real("c_name")}, ''), concat_ws(' ', c_mktsegment, c_name) FROM customer
  UNION ALL SELECT {5 * STRIDE} + o_orderkey, coalesce({_real("o_orderpriority")}, {_real("o_orderstatus")}, ''), concat_ws(' ', o_orderpriority, o_orderstatus) FROM orders
)"""
ORACLES["node_text"] = graph("SELECT node_id, CASE WHEN coalesce(d, '') <> '' THEN name || '. ' || d ELSE name END AS text FROM nodes LEFT JOIN described USING (node_id)", DESCRIBED)
ORACLES["desc_cumulative"] = graph("SELECT node_id, coalesce(whole, '') AS description FROM nodes LEFT JOIN described USING (node_id)", DESCRIBED)
ORACLES["desc_coverage"] = graph(
    "SELECT type, count(*) AS nodes, count(*) FILTER (WHERE coalesce(d, '') <> '') AS described, round(100.0 * count(*) FILTER (WHERE coalesce(d, '') <> '') / count(*), 6) AS percent FROM nodes LEFT JOIN described USING (node_id) GROUP BY type",
    DESCRIBED,
)

# ---- Metapaths ---------------------------------------------------------------------------------------------------


def chain(*parts: str) -> str:
    """FROM and WHERE of a chain type, relation, type, ...; its nodes are t.node_id, s1.other, s2.other, ..."""
    out, at = [f"nodes t{''.join('')}"], "t.node_id"
    where = [f"t.type = '{parts[0]}'"]
    for i in range(1, len(parts), 2):
        n = i // 2 + 1
        out.append(f"JOIN steps s{n} ON s{n}.node = {at} AND s{n}.relation = '{parts[i]}' AND s{n}.other_type = '{parts[i + 1]}'")
        at = f"s{n}.other"
    return "FROM " + " ".join(out) + " WHERE " + " AND ".join(where)


ORACLES["metapath_1hop"] = graph(f"SELECT t.node_id AS topic, s1.other AS answer, count(*) AS paths {chain('customer', 'lives_in', 'nation')} GROUP BY ALL")
ORACLES["metapath_2hop"] = graph(f"SELECT t.node_id AS topic, s2.other AS answer, count(*) AS paths {chain('customer', 'lives_in', 'nation', 'in_region', 'region')} GROUP BY ALL")
ORACLES["metapath_3hop"] = graph(f"SELECT t.node_id AS topic, s3.other AS answer, count(*) AS paths {chain('region', 'in_region', 'nation', 'based_in', 'supplier', 'shipped_by', 'order')} GROUP BY ALL")
ORACLES["metapath_exists"] = graph(f"SELECT DISTINCT t.node_id AS topic {chain('customer', 'placed', 'order', 'contains', 'part', 'has_brand', 'brand')}")
ORACLES["metapath_two_topic"] = graph(f"SELECT t.node_id AS topic, s3.other AS second_topic, s2.other AS answer, count(*) AS paths {chain('region', 'in_region', 'nation', 'lives_in', 'customer', 'in_segment', 'segment')} GROUP BY ALL")
ORACLES["metapath_compound"] = graph(
    f"SELECT t.node_id AS topic, s1.other AS answer {chain('customer', 'lives_in', 'nation')} INTERSECT SELECT t.node_id, s3.other {chain('customer', 'placed', 'order', 'shipped_by', 'supplier', 'based_in', 'nation')}"
)
ORACLES["pattern_traversable"] = graph(
    f"""SELECT DISTINCT t.node_id AS topic, 0 AS pattern {chain("region", "in_region", "nation", "lives_in", "customer", "placed", "order")}
UNION ALL SELECT DISTINCT t.node_id, 1 {chain("region", "in_region", "nation", "based_in", "supplier", "shipped_by", "order")}
UNION ALL SELECT DISTINCT t.node_id, 2 {chain("region", "in_region", "nation", "supplied_by", "part")}
UNION ALL SELECT DISTINCT t.node_id, 3 {chain("nation", "lives_in", "customer")}"""
)

# ---- Retrieval -----------------------------------------------------------------------------------------------------

UNICODE = r"list_filter(string_split(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), ' '), lambda w: w <> '')"
SPACED = "string_split({0}, ' ')"


def bm25(docs: str, queries: str, name: str = "", b: float = 0.0, tokens: str = UNICODE) -> str:
    """CTEs words, p (postings), lex, terms and scores, with a suffix."""
    x = name
    return f"""
docs{x} AS MATERIALIZED (SELECT doc, {tokens.format("coalesce(text, '')")} AS w FROM ({docs})),
tot{x} AS MATERIALIZED (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM docs{x}),
p{x} AS MATERIALIZED (SELECT doc, len, term, count(*) AS tf FROM (SELECT doc, len(w) AS len, unnest(w) AS term FROM docs{x}) GROUP BY ALL),
raw_lex{x} AS MATERIALIZED (SELECT term, count(*) AS df, ln((SELECT n FROM tot{x}) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p{x} GROUP BY term),
lex{x} AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw_lex{x}) ELSE raw END AS idf FROM raw_lex{x}),
terms{x} AS (SELECT query, term, count(*) AS qf FROM (SELECT query, unnest({tokens.format("coalesce(text, '')")}) AS term FROM ({queries})) GROUP BY ALL),
scores{x} AS MATERIALIZED (
  SELECT query, doc, sum(qf * idf * tf * 2.5 / (tf + 1.5 * ({1 - b} + {b} * len / (SELECT avg_len FROM tot{x})))) AS bm25
  FROM terms{x} JOIN lex{x} USING (term) JOIN p{x} USING (term) GROUP BY ALL
)"""


DOCUMENTS, ITEMS = "SELECT doc_id AS doc, text FROM documents", "SELECT item_id AS query, text FROM benchmark"
BM25_DOCUMENTS = bm25(DOCUMENTS, ITEMS)
TOP5 = "SELECT query, rank, doc, bm25 FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY bm25 DESC, doc) AS INTEGER) AS rank FROM (SELECT query, doc, round(bm25, 6) AS bm25 FROM scores)) WHERE rank <= 5"
ORACLES["bm25_lexicon"] = f"WITH {BM25_DOCUMENTS} SELECT term, df, round(idf, 6) AS idf FROM lex"
ORACLES["bm25_scores"] = f"WITH {BM25_DOCUMENTS} SELECT query, doc, round(bm25, 6) AS bm25 FROM scores"
ORACLES["bm25_topk"] = f"WITH {BM25_DOCUMENTS} {TOP5}"
ORACLES["bm25_store"] = ORACLES["bm25_blockmax"] = ORACLES["bm25_topk"]
ORACLES["bm25_default_b"] = f"WITH {bm25(DOCUMENTS, ITEMS, b=0.75, tokens=SPACED)} {TOP5}"


def similar(name: str) -> str:
    """sims: BM25 of every doc and query, min-max normalised over all docs."""
    x = name
    return f"""
ends{x} AS MATERIALIZED (
  SELECT query, CASE WHEN count(*) < (SELECT count(*) FROM docs{x}) THEN least(min(bm25), 0) ELSE min(bm25) END AS low,
    CASE WHEN count(*) < (SELECT count(*) FROM docs{x}) THEN greatest(max(bm25), 0) ELSE max(bm25) END AS high FROM scores{x} GROUP BY query
),
sims{x} AS MATERIALIZED (
  SELECT q.query, d.doc, coalesce((coalesce(s.bm25, 0.0) - e.low) / (e.high - e.low + 1e-8), 0.0) AS sim
  FROM (SELECT DISTINCT query FROM asked) q CROSS JOIN docs{x} d LEFT JOIN scores{x} s ON s.query = q.query AND s.doc = d.doc LEFT JOIN ends{x} e ON e.query = q.query
)"""


ASKED = "asked AS (SELECT CAST(r_regionkey AS BIGINT) AS query, lower(r_name) || ' customer supplier small ring nation_' || r_regionkey || ' lives shipped order' AS text FROM region)"
REL_DOCS = "SELECT rel_id AS doc, replace(relation, '_', ' ') || ' ' || description AS text FROM rels"
RELATION_SIMS = bm25(REL_DOCS, "SELECT query, text FROM asked", "_r") + "," + similar("_r")
ORACLES["bm25_relation_similarity"] = graph("SELECT query, doc AS rel_id, round(sim, 6) AS sim FROM sims_r", ASKED, RELATION_SIMS)

SENTENCES = r"list_filter(list_transform(string_split(replace(coalesce(text, ''), chr(10), '. '), '. '), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) > 10)"
ORACLES["best_chunk"] = rf"""
WITH s AS (SELECT doc_id AS doc, doc_id % (SELECT count(*) FROM benchmark) AS item, unnest(list) AS piece, CAST(generate_subscripts(list, 1) - 1 AS BIGINT) AS pos FROM (SELECT doc_id, {SENTENCES} AS list FROM documents)),
w AS (SELECT *, list_filter(regexp_split_to_array(lower(piece), '\s+'), lambda x: x <> '') AS w FROM s),
t AS (SELECT doc, count(*) AS n, avg(len(w)) AS avg_len FROM w GROUP BY doc),
p AS (SELECT doc, pos, len, term, count(*) AS tf FROM (SELECT doc, pos, len(w) AS len, unnest(w) AS term FROM w) GROUP BY ALL),
l AS (SELECT doc, term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p JOIN t USING (doc) GROUP BY doc, term),
i AS (SELECT doc, term, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY doc) ELSE raw END AS idf FROM l),
q AS (SELECT item_id AS item, term, count(*) AS qf FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS term FROM benchmark) GROUP BY ALL),
c AS (SELECT doc, pos, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 9) AS score FROM p JOIN t USING (doc) JOIN i USING (doc, term) JOIN q ON q.item = doc % (SELECT count(*) FROM benchmark) AND q.term = p.term GROUP BY doc, pos)
SELECT doc, pos, piece, round(score, 6) AS score FROM (
  SELECT doc, pos, piece, coalesce(score, 0.0) AS score, row_number() OVER (PARTITION BY doc ORDER BY coalesce(score, 0.0) DESC, pos) AS k FROM s LEFT JOIN c USING (doc, pos)) WHERE k = 1
"""
ORACLES["norm_minmax"] = "SELECT event_id, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w + 1e-8), 6) AS x FROM events WINDOW w AS (PARTITION BY event_type)"
ORACLES["norm_max"] = "SELECT event_id, round(value / (max(value) OVER w + 1e-8), 6) AS x FROM events WINDOW w AS (PARTITION BY user_id)"
ORACLES["norm_sum"] = "SELECT event_id, round(CASE WHEN sum(value) OVER w > 0 THEN value / sum(value) OVER w ELSE 1.0 / count(*) OVER w END, 6) AS x FROM events WINDOW w AS (PARTITION BY user_id)"

POOL = f"""{BM25_DOCUMENTS},
pool AS MATERIALIZED (
  SELECT b.item_id AS test, d.doc_id AS train, d.doc_id AS data_id, CAST(d.doc_id % 3 + 1 AS INTEGER) AS hop,
    list_dot_product(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(c.embedding, lambda x: CAST(x AS DOUBLE))) AS dense, coalesce(s.bm25, 0.0) AS bm25
  FROM benchmark b JOIN embeddings a ON a.vec_id = b.item_id JOIN embeddings c ON c.label = a.label JOIN documents d ON d.doc_id = c.vec_id
    LEFT JOIN scores s ON s.query = b.item_id AND s.doc = d.doc_id
),
hybrid AS MATERIALIZED (
  SELECT *, round(0.5 * (dense - min(dense) OVER w) / (max(dense) OVER w - min(dense) OVER w + 1e-8) + 0.5 * (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w + 1e-8), 6) AS hybrid
  FROM pool WINDOW w AS (PARTITION BY test)
),
top_trains AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY test ORDER BY hybrid DESC, data_id) AS INTEGER) AS rank FROM (SELECT test, data_id, max(hybrid) AS hybrid FROM hybrid GROUP BY ALL)) WHERE rank <= 5
)"""
ORACLES["dense_topk"] = f"WITH {POOL} SELECT test, rank, train, dense FROM (SELECT test, train, round(dense, 6) AS dense, CAST(row_number() OVER (PARTITION BY test ORDER BY round(dense, 6) DESC, train) AS INTEGER) AS rank FROM pool) WHERE rank <= 3"
ORACLES["hybrid_match_topk"] = f"WITH {POOL} SELECT test, rank, data_id, hybrid FROM top_trains"
ORACLES["hybrid_match_per_hop"] = f"WITH {POOL} SELECT test, hop, train, hybrid FROM (SELECT *, row_number() OVER (PARTITION BY test, hop ORDER BY hybrid DESC, train) AS n FROM hybrid) WHERE n = 1"
BANK = f"""{POOL},
bank AS (
  SELECT o_custkey % 500 AS data_id, hop, array_to_string([c_mktsegment, o_orderstatus, p_type, p_brand][1 : hop + 1], '>') AS types, array_to_string([o_orderpriority, l_returnflag, l_linestatus][1 : hop], '>') AS relations
  FROM (SELECT *, CASE WHEN l_linenumber > 4 THEN 3 WHEN l_linenumber > 1 THEN 2 ELSE 1 END AS hop FROM lineitem)
    JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey
),
patterns AS (SELECT test, hop, types, relations, count(*) AS n FROM top_trains JOIN bank USING (data_id) GROUP BY ALL)"""
ORACLES["match_patterns"] = f"WITH {BANK} SELECT * FROM patterns"
ORACLES["hash_sample_cap"] = f"""WITH {BANK} SELECT test, hop, types, relations FROM
  (SELECT *, row_number() OVER (PARTITION BY test, hop ORDER BY md5('42|' || types || '|' || relations)) AS k FROM patterns) WHERE k <= [2, 4, 8][hop]"""
ORACLES["commonest_hop"] = f"WITH {BANK}, c AS (SELECT test, hop, count(*) AS n FROM patterns GROUP BY ALL) SELECT test, first(hop ORDER BY n DESC, hop) AS hop, max(n) AS n FROM c GROUP BY test"

ORACLES["match_typed_patterns"] = f"""WITH {BANK} SELECT test, hop, types, relations, count(*) AS n FROM top_trains JOIN bank USING (data_id)
  WHERE test % 3 = 2 OR list_last(string_split(types, '>')) = CASE test % 3 WHEN 0 THEN 'F' ELSE 'SMALL' END GROUP BY ALL"""
ORACLES["match_fallback"] = f"""WITH {POOL},
fit AS (SELECT * EXCLUDE (own, hit) FROM (SELECT *, hop = test % 4 + 1 AS own, bool_or(hop = test % 4 + 1) OVER (PARTITION BY test) AS hit FROM pool) WHERE own OR NOT hit),
h AS (SELECT *, round(0.5 * (dense - min(dense) OVER w) / (max(dense) OVER w - min(dense) OVER w + 1e-8) + 0.5 * (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w + 1e-8), 6) AS hybrid FROM fit WINDOW w AS (PARTITION BY test))
SELECT test, hop, train, hybrid FROM (SELECT *, row_number() OVER (PARTITION BY test, hop ORDER BY hybrid DESC, train) AS n FROM h) WHERE n = 1"""
_vector = lambda text: "[" + ", ".join(f"CAST(length(lower({text})) - length(replace(lower({text}), '{c}', '')) AS DOUBLE)" for c in "aeinorst") + "]"
_unit = "list_transform({0}, lambda x: CASE WHEN list_dot_product({0}, {0}) > 0 THEN x / sqrt(list_dot_product({0}, {0})) ELSE 0.0 END)"
ORACLES["dense_encode_topk"] = f"""
WITH i AS (SELECT item_id, {_vector("coalesce(text, '')")} AS v FROM benchmark), d AS (SELECT doc_id, {_vector("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT item_id AS test, doc_id AS train, round(list_dot_product(a, b), 6) AS dense FROM (SELECT item_id, {_unit.format("v")} AS a FROM i) JOIN (SELECT doc_id, {_unit.format("w")} AS b FROM d) ON item_id % 5 = doc_id % 5)
SELECT test, rank, train, dense FROM (SELECT *, CAST(row_number() OVER (PARTITION BY test ORDER BY dense DESC, train) AS INTEGER) AS rank FROM s) WHERE rank <= 3"""

# ---- Weights, ranks, corridors, paths --------------------------------------------------------------------------------

WEIGHTS = f"""{ASKED},{bm25("SELECT node_id AS doc, name AS text FROM nodes", "SELECT query, text FROM asked", "_n")},{similar("_n")},{RELATION_SIMS},
weighted AS MATERIALIZED (
  SELECT r.query, e.u, e.v, e.rel_id, greatest(1e-6, 0.3 * r.sim + 0.7 * (a.sim + b.sim) / 2) AS weight
  FROM edges e JOIN sims_r r ON r.doc = e.rel_id JOIN sims_n a ON a.query = r.query AND a.doc = e.u JOIN sims_n b ON b.query = r.query AND b.doc = e.v
),
best AS MATERIALIZED (SELECT query, u, v, first(rel_id ORDER BY weight DESC, rel_id) AS rel_id, max(weight) AS weight FROM weighted GROUP BY query, u, v)"""
ORACLES["edge_weights"] = graph("SELECT query, rel_id, round(weight, 6) AS weight, count(*) AS edges FROM weighted GROUP BY ALL", WEIGHTS)
ORACLES["edge_costs"] = graph(
    """SELECT query, mode, round(CASE mode WHEN 'edge_weight' THEN 1 / (weight + 1e-8) WHEN 'ppr_only' THEN 1 / (p + 1e-8) ELSE 1 / (0.5 * weight + 0.5 * p + 1e-8) END, 4) AS cost, count(*) AS edges
FROM (SELECT best.*, (a.p + b.p) / 2 AS p FROM best JOIN share a ON a.node = u JOIN share b ON b.node = v) CROSS JOIN (VALUES ('edge_weight'), ('ppr_only'), ('ppr_mix')) m(mode) GROUP BY ALL""",
    WEIGHTS,
    "deg AS (SELECT node, count(*) AS degree FROM (SELECT u AS node FROM edges UNION ALL SELECT v FROM edges) GROUP BY node)",
    "share AS (SELECT node, degree / ((SELECT max(degree) FROM deg) + 1e-8) AS p FROM deg)",
)


def ranks(seeds: str, rounds: int = 12) -> str:
    """CTEs up to `rank`(run, node, pi): so many rounds of the walk, unrolled."""
    out = [
        """walk AS MATERIALIZED (
  SELECT query, node, other, weight / sum(weight) OVER (PARTITION BY query, node) AS share
  FROM (SELECT query, node, other, sum(weight) AS weight FROM (SELECT query, u AS node, v AS other, weight FROM best UNION ALL SELECT query, v, u, weight FROM best WHERE u <> v) GROUP BY ALL)
)""",
        f"seeds AS ({seeds})",
        "pi0 AS (SELECT run, query, node, reset AS pi FROM seeds)",
    ]
    for n in range(1, rounds + 1):
        out.append(
            f"""pi{n} AS MATERIALIZED (SELECT run, query, node, sum(pi) AS pi FROM (
  SELECT p.run, p.query, w.other AS node, 0.15 * p.pi * w.share AS pi FROM pi{n - 1} p JOIN walk w ON w.query = p.query AND w.node = p.node
  UNION ALL SELECT run, query, node, (1 - 0.15) * reset FROM seeds) GROUP BY ALL)"""
        )
    return ",\n".join([*out, f"rank AS MATERIALIZED (SELECT run, node, pi FROM pi{rounds})"])


PAIRS = f"pairs AS (SELECT CAST(r_regionkey AS BIGINT) AS pair, CAST(r_regionkey AS BIGINT) AS topic, {7 * STRIDE} + CAST(r_regionkey AS BIGINT) AS answer FROM region)"
RANKS = f"{WEIGHTS},\n{PAIRS},\n" + ranks("SELECT 't' || pair AS run, pair AS query, topic AS node, 1.0::DOUBLE AS reset FROM pairs UNION ALL SELECT 'a' || pair, pair, answer, 1.0 FROM pairs")
PRODUCT = RANKS + ",\nscore AS MATERIALIZED (SELECT pair, t.node, t.pi * a.pi AS score FROM pairs JOIN rank t ON t.run = 't' || pair JOIN rank a ON a.run = 'a' || pair AND a.node = t.node)"
ORACLES["ppr_topic"] = graph("SELECT run, node, round(ln(pi), 6) AS log_pi FROM rank", RANKS)
ORACLES["ppr_bidirectional"] = graph("SELECT pair, node, round(ln(score), 6) AS log_score FROM score", PRODUCT)
ORACLES["ppr_rank_product"] = graph(
    "SELECT t.pair, t.node, round(ln(t.r * a.r), 6) AS log_score FROM (SELECT * FROM placed WHERE side = 't') t JOIN (SELECT * FROM placed WHERE side = 'a') a ON a.pair = t.pair AND a.node = t.node",
    RANKS,
    "placed AS MATERIALIZED (SELECT run[1] AS side, CAST(run[2:] AS BIGINT) AS pair, node, 1.0::DOUBLE / row_number() OVER (PARTITION BY run ORDER BY round(ln(pi), 9) DESC, node) AS r FROM rank)",
)
_multi = """SELECT kind || '-' || pair AS run, pair AS query, node, CAST(reset AS DOUBLE) AS reset FROM (
  SELECT kind, pair, topic AS node, CASE kind WHEN 'uniform' THEN 0.5 WHEN 'degree_inv' THEN da / (dt + da) ELSE dt / (dt + da) END AS reset FROM ends
  UNION ALL SELECT kind, pair, answer, CASE kind WHEN 'uniform' THEN 0.5 WHEN 'degree_inv' THEN dt / (dt + da) ELSE da / (dt + da) END FROM ends)"""
ORACLES["ppr_multi_seed"] = graph(
    "SELECT run, node, round(ln(pi), 6) AS log_pi FROM rank",
    WEIGHTS,
    PAIRS,
    "deg AS (SELECT node, CAST(count(*) AS DOUBLE) AS d FROM (SELECT u AS node FROM edges UNION ALL SELECT v FROM edges) GROUP BY node)",
    "ends AS (SELECT kind, pairs.*, t.d AS dt, a.d AS da FROM pairs JOIN deg t ON t.node = topic JOIN deg a ON a.node = answer CROSS JOIN (VALUES ('uniform'), ('degree_inv'), ('degree_proportional')) k(kind))",
    ranks(_multi),
)
PLACED = PRODUCT + ",\nplace AS (SELECT pair, node, score, CAST(row_number() OVER (PARTITION BY pair ORDER BY round(ln(score), 9) DESC, node) AS INTEGER) AS place FROM score)"
ORACLES["corridor_topk"] = graph("SELECT pair, node, place FROM place WHERE place <= 150", PLACED)
CORRIDOR = f"""{PLACED},
rung AS MATERIALIZED (
  SELECT pair, node, max(score) AS score, min(width) AS width FROM (
    SELECT pair, node, score, CASE WHEN place <= 150 THEN 150 WHEN place <= 300 THEN 300 WHEN place <= 500 THEN 500 ELSE 1000 END AS width FROM place WHERE place <= 1000
    UNION ALL SELECT pair, node, coalesce(score, 0), 150 FROM (SELECT pair, unnest([topic, answer]) AS node FROM pairs) LEFT JOIN score USING (pair, node)
  ) GROUP BY ALL
),
inner_edges AS MATERIALIZED (SELECT a.pair, e.u, e.v, e.rel_id, e.weight, greatest(a.width, b.width) AS width FROM best e JOIN rung a ON a.pair = e.query AND a.node = e.u JOIN rung b ON b.pair = e.query AND b.node = e.v),
reach(pair, k, node) AS (
  SELECT pair, k, topic FROM pairs CROSS JOIN (VALUES (150), (300), (500), (1000)) l(k)
  UNION SELECT r.pair, r.k, s.other FROM reach r JOIN (SELECT pair, u AS node, v AS other, width FROM inner_edges UNION ALL SELECT pair, v, u, width FROM inner_edges) s ON s.pair = r.pair AND s.node = r.node AND s.width <= r.k
),
widths AS MATERIALIZED (SELECT p.pair, p.topic, p.answer, min(r.k) AS width FROM pairs p LEFT JOIN reach r ON r.pair = p.pair AND r.node = p.answer GROUP BY ALL),
inside AS MATERIALIZED (SELECT g.pair, g.node, g.score / (max(g.score) OVER (PARTITION BY g.pair) + 1e-8) AS p FROM rung g JOIN widths w ON w.pair = g.pair AND g.width <= w.width),
held AS MATERIALIZED (SELECT e.pair, e.u, e.v, e.rel_id, e.weight, (a.p + b.p) / 2 AS p FROM inner_edges e JOIN inside a ON a.pair = e.pair AND a.node = e.u JOIN inside b ON b.pair = e.pair AND b.node = e.v)"""
ORACLES["corridor_ladder"] = graph(
    "SELECT w.*, n.nodes, e.edges FROM widths w LEFT JOIN (SELECT pair, count(*) AS nodes FROM inside GROUP BY pair) n USING (pair) LEFT JOIN (SELECT pair, count(*) AS edges FROM held GROUP BY pair) e USING (pair)",
    CORRIDOR,
    recursive=True,
)


def simple_paths(edges: str, pairs: str, hops: int) -> str:
    """found(pair, hop, nodes, rels, cost): simple paths as joins of `edges`(pair, u, v, rel_id, cost)."""
    out = [f"g AS MATERIALIZED (SELECT pair, u AS a, v AS b, rel_id, cost FROM ({edges}) WHERE u <> v UNION ALL SELECT pair, v, u, rel_id, cost FROM ({edges}) WHERE u <> v)"]
    selects = []
    for h in range(1, hops + 1):
        joins = [f"JOIN g e{i} ON e{i}.pair = p.pair AND e{i}.a = {'p.topic' if i == 1 else f'e{i - 1}.b'}" + (" AND e%d.b = p.answer" % i if i == h else "") for i in range(1, h + 1)]
        visited = ["p.topic", *(f"e{i}.b" for i in range(1, h + 1))]
        distinct = [f"{visited[i]} <> {visited[j]}" for i in range(h + 1) for j in range(i)]
        selects.append(f"SELECT p.pair, {h} AS hop, [{', '.join(visited)}] AS nodes, [{', '.join(f'e{i}.rel_id' for i in range(1, h + 1))}] AS rels, round({' + '.join(f'e{i}.cost' for i in range(1, h + 1))}, 9) AS cost FROM {pairs} p {' '.join(joins)} WHERE {' AND '.join(distinct)}")
    return ",\n".join([*out, "found AS MATERIALIZED (" + "\nUNION ALL ".join(selects) + ")"])


TYPED = """typed AS MATERIALIZED (SELECT f.*, (SELECT array_to_string(list(n.type ORDER BY i), '>') FROM (SELECT unnest(f.nodes) AS id, generate_subscripts(f.nodes, 1) AS i) x JOIN nodes n ON n.node_id = x.id) AS types FROM found f)"""
SHOWN = "SELECT pair, hop, CAST(rank AS INTEGER) AS rank, array_to_string(nodes, '>') AS nodes, array_to_string(rels, '>') AS rels, round(cost, 6) AS cost FROM ({0}) WHERE rank <= 5"
_cost = {"ppr_mix": "1 / (0.5 * weight + 0.5 * p + 1e-8)", "edge_weight": "1 / (weight + 1e-8)", "ppr_only": "1 / (p + 1e-8)"}
_found = lambda mode: simple_paths(f"SELECT pair, u, v, rel_id, {_cost[mode]} AS cost FROM held", "widths", 5)
ORACLES["ksp_global"] = graph(SHOWN.format("SELECT *, row_number() OVER (PARTITION BY pair ORDER BY cost, nodes) AS rank FROM found"), CORRIDOR, _found("ppr_mix"), recursive=True)
ORACLES["ksp_by_hop"] = graph(SHOWN.format("SELECT *, row_number() OVER (PARTITION BY pair, hop ORDER BY cost, nodes) AS rank FROM found"), CORRIDOR, _found("ppr_mix"), recursive=True)
ORACLES["ksp_dedup_type_sig"] = graph(
    SHOWN.format("SELECT *, row_number() OVER (PARTITION BY pair, hop ORDER BY cost, nodes) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY pair, hop, types, rels ORDER BY cost, nodes) AS k FROM typed) WHERE k = 1"),
    CORRIDOR,
    _found("edge_weight"),
    TYPED,
    recursive=True,
)
ORACLES["ksp_dedup_first_type"] = graph(
    SHOWN.format("SELECT *, row_number() OVER (PARTITION BY pair, hop ORDER BY k > 1, cost, nodes) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY pair, hop, string_split(types, '>')[2] ORDER BY cost, nodes) AS k FROM typed)"),
    CORRIDOR,
    _found("ppr_only"),
    TYPED,
    recursive=True,
)
ORACLES["path_bank"] = graph(
    """SELECT CAST(pair AS VARCHAR) AS data_id, topic, answer, width, false AS fallback, best, hop, CAST(rank AS INTEGER) AS rank, array_to_string(nodes, '>') AS nodes,
  array_to_string(list_transform(rels, lambda r: replace(['in_region', 'lives_in', 'based_in', 'in_segment', 'placed', 'contains', 'shipped_by', 'supplied_by', 'has_brand'][r + 1], '_', ' ')), '>') AS relations, round(cost, 6) AS cost
FROM (SELECT 'overall' AS best, *, row_number() OVER (PARTITION BY pair ORDER BY cost, nodes) AS rank FROM found UNION ALL SELECT 'hop', *, row_number() OVER (PARTITION BY pair, hop ORDER BY cost, nodes) FROM found) JOIN widths USING (pair) WHERE rank <= 5""",
    CORRIDOR,
    _found("ppr_mix"),
    recursive=True,
)
ORACLES["path_display"] = """SELECT 3000000000 + s_suppkey AS n2, r_name || ' →[in_region]→ ' || n_name || ' →[based_in]→ ' || s_name AS shown FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

# ---- Beam search -----------------------------------------------------------------------------------------------------

HAVE = "have AS MATERIALIZED (SELECT DISTINCT node, relation FROM steps)"
RAW = "CAST((({entity} % 1000003) * 7919 + {number} * 31 + length({relation}) * 17) % 1000 AS DOUBLE) / 1000.0"
PATTERNS = """asked AS (
  SELECT CAST(r_regionkey AS BIGINT) AS question, CAST(r_regionkey AS BIGINT) AS topic, p.* FROM region CROSS JOIN (VALUES
    (0, ['region', 'nation', 'customer', 'order'], ['in_region', 'lives_in', 'placed']),
    (1, ['region', 'nation', 'supplier', 'order'], ['in_region', 'based_in', 'shipped_by']),
    (2, ['region', 'nation', 'part'], ['in_region', 'supplied_by'])) p(path, types, relations)
)"""


def scored(source: str, relation_score: str, out: str) -> str:
    """Grouped scores of source(q, relation, entity, parent, raw), then the three best that aren't 0."""
    return f"""
{out}_a AS (SELECT *, count(*) OVER (PARTITION BY q, relation) AS size, row_number() OVER (PARTITION BY q, relation ORDER BY raw DESC, entity) AS place FROM {source}),
{out}_b AS (SELECT *, min(size) OVER (PARTITION BY q) < 5 AND sum(CASE WHEN place = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY q) > 1 AS merged FROM {out}_a),
{out}_c AS (SELECT *, CASE WHEN merged THEN CASE WHEN sum(raw) OVER w > 0 THEN raw / sum(raw) OVER w ELSE 1.0::DOUBLE / count(*) OVER w END
    ELSE (CASE WHEN sum(raw) OVER v > 0 THEN raw / sum(raw) OVER v ELSE 1.0::DOUBLE / count(*) OVER v END) * {relation_score} END AS score
  FROM {out}_b WHERE place <= 5 WINDOW w AS (PARTITION BY q), v AS (PARTITION BY q, relation)),
{out} AS MATERIALIZED (SELECT q, parent, relation, entity, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, entity) AS k FROM {out}_c) WHERE k <= 3 AND score <> 0)"""


def _depth(i: int) -> str:
    front = "(SELECT question || '#' || path AS q, topic AS node FROM asked)" if i == 1 else f"(SELECT q, entity AS node FROM block{i - 1})"
    return f"""
cand{i} AS (
  SELECT f.q, f.node AS parent, a.relations[{i}] AS relation, a.relations[{i + 1}] AS next, s.other AS entity, s.other_type = a.types[{i + 1}] AS fits
  FROM {front} f JOIN asked a ON f.q = a.question || '#' || a.path JOIN steps s ON s.node = f.node AND s.relation = a.relations[{i}]
),
typed{i} AS (SELECT * FROM (SELECT *, bool_or(fits) OVER (PARTITION BY q, parent) AS hit FROM cand{i}) WHERE fits OR NOT hit),
lead{i} AS (SELECT c.*, h.node IS NOT NULL AS leads FROM typed{i} c LEFT JOIN have h ON h.node = c.entity AND h.relation = c.next),
kept{i} AS (SELECT * FROM (SELECT *, bool_or(leads) OVER (PARTITION BY q, parent) AS onward FROM lead{i}) WHERE leads OR NOT onward),
once{i} AS (SELECT q, relation, entity, min(parent) AS parent, {RAW.format(entity="entity", number="CAST(string_split(q, '#')[1] AS BIGINT)", relation="relation")} AS raw FROM kept{i} GROUP BY q, relation, entity),
{scored(f"once{i}", "1.0", f"block{i}")}"""


GUIDED = ",\n".join([HAVE, PATTERNS, *map(_depth, (1, 2, 3))]) + """,
triples AS MATERIALIZED (SELECT string_split(q, '#')[1] AS question, CAST(string_split(q, '#')[2] AS INTEGER) AS path, depth, parent AS source, relation, entity, score FROM (
  SELECT *, 1 AS depth FROM block1 UNION ALL SELECT *, 2 FROM block2 UNION ALL SELECT *, 3 FROM block3))"""
ORACLES["beam_guided"] = graph("SELECT question, path, depth, source, relation, entity, round(score, 6) AS score FROM triples", GUIDED)
ORACLES["beam_success"] = graph(
    "SELECT CAST(a.question AS VARCHAR) AS question, a.path, coalesce(d.n, 0) = len(a.relations) AS success FROM asked a LEFT JOIN (SELECT question, path, count(DISTINCT depth) AS n FROM triples GROUP BY ALL) d ON d.question = CAST(a.question AS VARCHAR) AND d.path = a.path",
    GUIDED,
)
ORACLES["beam_explored"] = graph("SELECT question, entity, round(max(score), 6) AS score FROM triples GROUP BY question, entity", GUIDED)
ORACLES["beam_distinct_triples"] = graph("SELECT question, source, relation, entity, min(depth) AS depth FROM triples GROUP BY ALL", GUIDED)


def _free(i: int) -> str:
    front = "(SELECT CAST(r_regionkey AS VARCHAR) AS q, CAST(r_regionkey AS BIGINT) AS node FROM region)" if i == 1 else f"(SELECT DISTINCT q, entity AS node FROM block{i - 1})"
    seen = "SELECT '' AS q, '' AS relation WHERE false" if i == 1 else f"SELECT DISTINCT q, relation FROM block{i - 1}"
    return f"""
around{i} AS MATERIALIZED (SELECT f.q, f.node, s.other, s.relation FROM {front} f JOIN steps s ON s.node = f.node),
rel{i} AS (SELECT q, relation, CAST((length(relation) * 37 + CAST(q AS BIGINT) * 11) % 10 AS DOUBLE) / 10.0 AS raw FROM (SELECT DISTINCT q, relation FROM around{i}) WHERE (q, relation) NOT IN ({seen})),
best{i} AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY q) AS n, row_number() OVER (PARTITION BY q ORDER BY raw DESC, relation) AS k FROM rel{i}) WHERE k <= 3),
chosen{i} AS (SELECT q, relation, CASE WHEN n <= 3 THEN 1.0::DOUBLE / n WHEN sum(raw) OVER (PARTITION BY q) = 0 THEN 1.0::DOUBLE / count(*) OVER (PARTITION BY q) ELSE raw END AS rs FROM best{i}),
once{i} AS (SELECT a.q, a.relation, c.rs, a.other AS entity, min(a.node) AS parent, {RAW.format(entity="a.other", number="CAST(a.q AS BIGINT)", relation="a.relation")} AS raw FROM around{i} a JOIN chosen{i} c ON c.q = a.q AND c.relation = a.relation GROUP BY ALL),
{scored(f"once{i}", "rs", f"block{i}")}"""


ORACLES["beam_free"] = graph(
    "SELECT q AS question, depth, parent AS source, relation, entity, round(score, 6) AS score FROM (SELECT *, 1 AS depth FROM block1 UNION ALL SELECT *, 2 FROM block2 UNION ALL SELECT *, 3 FROM block3)", *map(_free, (1, 2, 3))
)
NATIONS = f"around AS MATERIALIZED (SELECT CAST(node % {STRIDE} AS VARCHAR) AS q, relation, node AS parent, other AS entity, other_type, {RAW.format(entity='other', number=f'(node % {STRIDE})', relation='relation')} AS raw FROM steps WHERE node BETWEEN {STRIDE} AND {2 * STRIDE - 1})"
ORACLES["beam_keep_if_any"] = graph("SELECT q AS question, other_type, count(*) AS n FROM (SELECT *, bool_or(other_type = 'supplier') OVER (PARTITION BY q) AS hit FROM around) WHERE other_type = 'supplier' OR NOT hit GROUP BY ALL", NATIONS)
ORACLES["beam_next_relation"] = graph(
    "SELECT q AS question, relation, count(*) AS n FROM (SELECT a.*, h.node IS NOT NULL AS leads, bool_or(h.node IS NOT NULL) OVER (PARTITION BY a.q, a.relation) AS hit FROM around a LEFT JOIN have h ON h.node = a.entity AND h.relation = 'shipped_by') WHERE leads OR NOT hit GROUP BY ALL",
    HAVE,
    NATIONS,
)
ORACLES["beam_grouped_scores"] = graph("SELECT q AS question, relation, entity, round(score, 6) AS score FROM out_c", NATIONS, scored("around", "0.5", "out"))
ORACLES["beam_prune"] = graph("SELECT q AS question, CAST(k AS INTEGER) AS rank, entity, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, entity) AS k FROM (SELECT q, entity, floor(raw * 10) / 10 AS score FROM around)) WHERE k <= 3 AND score <> 0", NATIONS)
ORACLES["beam_parent_scores"] = graph(
    "SELECT q AS question, relation, entity, round(CASE WHEN count(*) OVER w = 1 THEN 0.25 WHEN sum(raw) OVER w > 0 THEN raw * 0.25 ELSE 0.25 / count(*) OVER w END, 6) AS score FROM around WINDOW w AS (PARTITION BY q, relation, parent)", NATIONS
)
ORACLES["beam_relation_choice"] = graph(
    "SELECT question, relation, round(CASE WHEN n <= 2 THEN 1.0 / n WHEN sum(raw) OVER w = 0 THEN 1.0 / count(*) OVER w ELSE raw END, 6) AS score FROM (SELECT *, count(*) OVER v AS n, row_number() OVER (PARTITION BY question ORDER BY raw DESC, relation) AS k FROM some_relations WINDOW v AS (PARTITION BY question)) WHERE k <= 2 WINDOW w AS (PARTITION BY question)",
    HAVE,
    f"some_relations AS (SELECT CAST(node AS VARCHAR) AS question, relation, CAST((length(relation) * 37 + node % 1000 * 11) % 10 AS DOUBLE) / 10 AS raw FROM have WHERE node // {STRIDE} IN (3, 5))",
)
ORACLES["beam_down_sample"] = graph("SELECT q AS question, relation, entity FROM (SELECT *, count(*) OVER (PARTITION BY q, relation) AS n, row_number() OVER (PARTITION BY q, relation ORDER BY raw DESC, entity) AS k FROM around) WHERE n < 20 OR k <= 10", NATIONS)
ORACLES["beam_random_sample"] = graph(
    "SELECT q AS question, relation, entity FROM (SELECT *, count(*) OVER (PARTITION BY q, relation) AS n, row_number() OVER (PARTITION BY q, relation ORDER BY md5('42|' || q || '|' || relation || '|' || entity), entity) AS k FROM around) WHERE n < 20 OR k <= 10", NATIONS
)
ORACLES["beam_by_name"] = graph("SELECT q AS question, relation, entity, name, CAST(row_number() OVER (PARTITION BY q, relation ORDER BY name, entity) AS INTEGER) AS ord FROM around JOIN nodes ON node_id = entity", NATIONS)
ORACLES["beam_dense_scores"] = graph(
    "SELECT q AS question, relation, entity, round(0.5 * CASE WHEN sum(r) OVER w > 0 THEN r / sum(r) OVER w ELSE 1.0::DOUBLE / count(*) OVER w END, 6) AS score FROM (SELECT *, greatest(raw - 0.25, 0.0) AS r FROM around) WINDOW w AS (PARTITION BY q, relation)", NATIONS
)
ORACLES["beam_cascade"] = graph(
    "SELECT a.q AS question, a.relation AS source, a.entity, round(a.raw * s.share, 6) AS score FROM around a JOIN (SELECT q, relation, k / sum(k) OVER (PARTITION BY q) AS share FROM (SELECT DISTINCT q, relation, CAST(length(relation) AS DOUBLE) / 10.0 AS k FROM around)) s ON s.q = a.q AND s.relation = a.relation",
    NATIONS,
)
ORACLES["beam_leading_relations"] = graph(
    f"SELECT CAST(node AS VARCHAR) AS question, relation FROM (SELECT node, relation, leads, bool_or(leads) OVER (PARTITION BY node) AS hit FROM (SELECT node, relation, bool_or(other_type = 'order') AS leads FROM steps WHERE node // {STRIDE} IN (0, 2) GROUP BY ALL)) WHERE leads OR NOT hit"
)
ORACLES["beam_stop_half"] = graph("SELECT question, path, depth, source, relation, entity FROM triples WHERE depth <= 2", GUIDED)
ORACLES["beam_free_until_enough"] = graph(
    "SELECT q AS question, depth, parent AS source, relation, entity, round(score, 6) AS score FROM (SELECT *, 1 AS depth FROM block1 UNION ALL SELECT *, 2 FROM block2 WHERE CAST(q AS BIGINT) % 2 = 1 UNION ALL SELECT *, 3 FROM block3 WHERE CAST(q AS BIGINT) % 2 = 1)", *map(_free, (1, 2, 3))
)
ORACLES["beam_first_source"] = graph("SELECT 'all' AS question, other AS entity, min(node) AS source FROM steps WHERE relation = 'shipped_by' AND other_type = 'supplier' GROUP BY other")
ORACLES["beam_advance_hops"] = """
SELECT CAST(c_nationkey AS VARCHAR) AS question, c_custkey AS origin, CAST(least(c_custkey % 3 + CASE WHEN o_custkey IS NULL THEN 0 ELSE 1 END, 2) AS INTEGER) AS current_hop, 2 AS total_hops
FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') ON o_custkey = c_custkey"""
ORACLES["path_assembly"] = """
SELECT r_name || '|in_region|' || n_name || CASE WHEN s_name IS NULL THEN '' ELSE ' / ' || lower(n_name) || '|based_in|' || s_name END AS path
FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) ON s_nationkey = n_nationkey"""

# ---- Responses -------------------------------------------------------------------------------------------------------

SAID = r"""
r AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN '{ Yes }. The answer is {' WHEN turn = 0 THEN 'no braces } here {' ELSE 'So {' END || coalesce(text, '') || '} indeed' AS response FROM conversations),
m AS (SELECT *, regexp_extract_all(response, '\{([^}]+)\}', 1) AS b FROM r),
said AS (
  SELECT conv_id, turn, response, coalesce(regexp_replace(CASE WHEN len(b) >= 2 AND regexp_replace(lower(b[1]), '^\s+|\s+$', '', 'g') IN ('yes', 'no') THEN b[2] ELSE b[1] END, '^\s+|\s+$', '', 'g'), '') AS final,
    CASE WHEN strpos(response, '{') > 0 AND strpos(response, '}') > strpos(response, '{') THEN regexp_replace(substr(response, strpos(response, '{') + 1, strpos(response, '}') - strpos(response, '{') - 1), '^\s+|\s+$', '', 'g') ELSE '' END AS reasoned FROM m
)"""
_normal = r"lower(replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), ' ', ''))"
ORACLES["answer_extract"] = f"WITH {SAID} SELECT conv_id, turn, final, reasoned, {_normal.format('reasoned')} = 'yes' AS yes, {_normal.format('final')} AS normal FROM said"
ORACLES["em_match"] = f"WITH {SAID}, n AS (SELECT conv_id, turn, name, {_normal.format('final')} AS a, {_normal.format('name')} AS b FROM said CROSS JOIN (SELECT substr(r_name, 1, 2) AS name FROM region)) SELECT conv_id, turn, name, a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a)) AS matches FROM n"
ORACLES["em_per_hop"] = f"""WITH {SAID},
j AS (
  SELECT CAST(d.doc_id % 4 + 1 AS INTEGER) AS hop, {_normal.format("CASE WHEN s.final <> '' THEN s.final ELSE s.response END")} AS a, {_normal.format("d.lang")} AS l, {_normal.format("d.source")} AS o
  FROM said s JOIN documents d ON d.doc_id = s.conv_id
), ok AS (SELECT hop, a <> '' AND (contains(a, l) OR contains(l, a) OR contains(a, o) OR contains(o, a)) AS correct FROM j WHERE hop <= 3)
SELECT h.hop AS num_hops, CAST(coalesce(sum(CAST(correct AS BIGINT)), 0) AS BIGINT) AS correct, count(correct) AS total, CASE WHEN count(correct) > 0 THEN round(100.0 * sum(CAST(correct AS BIGINT)) / count(correct), 6) ELSE 0.0 END AS percent
FROM (VALUES (0), (1), (2), (3)) h(hop) LEFT JOIN ok ON h.hop = 0 OR ok.hop = h.hop GROUP BY h.hop"""
ORACLES["valid_names"] = f"""
SELECT CAST(o_orderkey AS VARCHAR) AS data_id, CASE o_orderstatus WHEN 'F' THEN o_orderpriority WHEN 'P' THEN (SELECT string_agg(r_name, '|' ORDER BY r_name) FROM region WHERE r_regionkey IN (0, 1)) ELSE c_name END AS names
FROM orders JOIN customer ON o_custkey = c_custkey"""
ORACLES["score_list_parse"] = r"""
WITH x AS (SELECT l_orderkey, l_linenumber, l_linenumber % 3 + 1 AS n, regexp_extract_all(format('{:.2f}', l_discount) || ', ' || format('{:.2f}', l_tax) || ', ' || l_linenumber, '\d+\.\d+') AS f FROM lineitem)
SELECT l_orderkey, l_linenumber, n, array_to_string(list_transform(CASE WHEN len(f) = n THEN list_transform(f, lambda v: CAST(v AS DOUBLE)) ELSE list_transform(range(0, n), lambda i: 1.0::DOUBLE / n) END, lambda v: format('{:.4f}', v)), ' ') AS scores FROM x"""
ORACLES["relation_score_parse"] = """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'placed=0.' || (o_orderkey % 10) || ' has_brand=' || (o_custkey % 7) || '.0' END AS scores FROM orders"""
ORACLES["json_list_parse"] = "SELECT p_partkey, CASE WHEN p_size > 10 THEN p_name || '|' || p_brand ELSE '' END AS names FROM part"
ORACLES["subquery_parse"] = "SELECT p_partkey, CASE WHEN p_size > 10 THEN p_name END AS subquery, CASE WHEN p_size > 10 AND p_size <= 40 THEN p_type END AS target_type FROM part"
ORACLES["strip_choices"] = "SELECT p_partkey, 'Which brand has ' || p_name || CASE WHEN p_size > 10 THEN '?' ELSE '?' || chr(10) || 'A: one' || chr(10) || 'B: two' END AS question FROM part"
ORACLES["type_and_hop_parse"] = r"""
SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'drug' WHEN 'ECONOMY' THEN 'pathway' END AS type,
  CAST(list_filter(regexp_extract_all(CAST(p_size AS VARCHAR), '[0-9]'), lambda d: d IN ('1', '2', '3'))[1] AS INTEGER) AS hop,
  CASE p_type WHEN 'SMALL' THEN 'gene' WHEN 'ECONOMY' THEN 'pathway' ELSE 'Thing' END AS mentioned FROM part"""
ORACLES["tokenizers"] = rf"""SELECT doc_id, md5(array_to_string({UNICODE.format("text")}, '|')) AS "unicode", md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), '|')) AS ascii,
  md5(array_to_string(string_split(text, ' '), '|')) AS space, md5(array_to_string(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''), '|')) AS white, md5(array_to_string({SENTENCES}, '|')) AS sentence FROM documents"""

_strip = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_last = "strpos(reverse(substr(s, 1, 150)), ' ,')"
ORACLES["clause_chunks"] = rf"""
WITH RECURSIVE clauses AS (SELECT doc_id, generate_subscripts(l, 1) AS c, unnest(l) AS s FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.;])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {_strip.format("x")}), lambda x: x <> '') AS l FROM documents)),
cut(doc_id, c, i, piece, s) AS (
  SELECT doc_id, c, 0, '', s FROM clauses
  UNION ALL SELECT doc_id, c, i + 1, CASE WHEN length(s) <= 150 THEN s ELSE {_strip.format("substr(s, 1, b)")} END, CASE WHEN length(s) <= 150 THEN '' ELSE trim(substr(s, b + 1), ', ') END
  FROM (SELECT *, CASE WHEN {_last} = 0 OR 149 - {_last} < 50 THEN 150 ELSE 149 - {_last} END AS b FROM cut WHERE s <> '')
)
SELECT d.doc_id, CAST(count(c) AS INTEGER) AS chunks, CAST(coalesce(max(length(piece)), 0) AS INTEGER) AS longest, md5(coalesce(string_agg(piece, '|' ORDER BY c, i), '')) AS text
FROM documents d LEFT JOIN (SELECT * FROM cut WHERE i > 0) USING (doc_id) GROUP BY d.doc_id"""

# ---- Linking and records ---------------------------------------------------------------------------------------------

MENTIONS = """mentions AS (
  SELECT DISTINCT mention FROM (SELECT ' ' || lower(r_name) AS mention FROM region UNION ALL SELECT lower(p_type) FROM part UNION ALL SELECT p_brand FROM part
    UNION ALL SELECT 'big ' || p_name FROM part UNION ALL SELECT c_mktsegment || ' goods' FROM customer)
),
exact AS (SELECT mention, node_id FROM mentions JOIN nodes ON lower(trim(mention)) = lower(trim(name))),
near AS (
  SELECT mention, node_id, CAST(row_number() OVER (PARTITION BY mention ORDER BY abs(length(n) - length(m)), node_id) AS INTEGER) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY mention ORDER BY node_id) AS k FROM (SELECT mention, node_id, lower(name) AS n, lower(trim(mention)) AS m FROM mentions JOIN nodes ON contains(lower(name), lower(trim(mention))) OR contains(lower(trim(mention)), lower(name)))
  ) WHERE k <= 6
)"""
ORACLES["name_link"] = graph("SELECT mention, node_id FROM exact", MENTIONS)
ORACLES["substring_link"] = graph("SELECT mention, node_id, place FROM near WHERE place <= 3", MENTIONS)
LOWER_WORDS = r"list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda w: w <> '')"
ORACLES["entity_link"] = graph(
    "SELECT mention, node_id, stage, place FROM (SELECT *, min(stage) OVER (PARTITION BY mention) AS least FROM every) WHERE stage = least",
    MENTIONS,
    bm25("SELECT node_id AS doc, name AS text FROM nodes", "SELECT mention AS query, mention AS text FROM mentions", b=0.75, tokens=LOWER_WORDS),
    """every AS (
  SELECT mention, node_id, 1 AS stage, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY mention ORDER BY node_id) AS INTEGER) AS place FROM exact) WHERE place <= 3 UNION ALL SELECT mention, node_id, 2, place FROM near WHERE place <= 3
  UNION ALL SELECT query, doc, 3, k FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY bm25 DESC, doc) AS INTEGER) AS k FROM scores WHERE bm25 > 0) WHERE k <= 3
)""",
)
RECORDS = f"""lines AS (SELECT l_orderkey, min(l_partkey) + {4 * STRIDE} AS first FROM lineitem GROUP BY l_orderkey),
records AS (SELECT orders.*, first, CASE WHEN o_orderstatus = 'F' THEN o_orderkey + {5 * STRIDE} ELSE first END AS answer FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey)"""
ORACLES["record_pairs"] = f"""WITH {RECORDS} SELECT CAST(o_orderkey AS VARCHAR) AS data_id, CASE WHEN o_orderstatus <> 'O' THEN 'asked' ELSE 'explicit' END AS query, {2 * STRIDE} + o_custkey AS topic, answer,
  CASE WHEN o_orderstatus = 'P' THEN c_name ELSE 'given ' || o_custkey END AS topic_name, 'customer' AS topic_type, 'chain' AS role FROM records JOIN customer ON o_custkey = c_custkey WHERE answer IS NOT NULL"""
ORACLES["record_chains"] = f"""WITH {RECORDS} SELECT CAST(o_orderkey AS VARCHAR) AS data_id, 'chain' AS role, 'placed>?' AS relations FROM records WHERE first IS NOT NULL
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'direct', '?' FROM records WHERE first IS NOT NULL AND o_orderstatus = 'P'"""
ORACLES["records_with_triples"] = """SELECT CAST(o_orderkey AS VARCHAR) AS data_id, CASE WHEN o_orderstatus = 'F' THEN 'own|' || o_orderpriority || '|x' ELSE t END AS triple
FROM orders LEFT JOIN (SELECT l_orderkey, first(l_partkey || '|in|' || l_linestatus ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_linestatus DESC) AS t FROM lineitem WHERE l_returnflag <> 'A' GROUP BY l_orderkey) ON l_orderkey = o_orderkey"""
ORACLES["jsonl_first_lines"] = "SELECT CAST(o_orderkey AS VARCHAR) AS data_id, o_orderpriority AS query FROM orders ORDER BY o_orderkey LIMIT 1000"
ORACLES["path_bank_loader"] = """SELECT CAST(o_orderkey AS VARCHAR) AS data_id, CAST(o_custkey AS VARCHAR) AS topic_id, CAST(pos + 1 AS INTEGER) AS hop, CAST(pos AS INTEGER) AS pos,
  CASE pos WHEN 0 THEN 'customer>order' ELSE 'customer>' || o_orderstatus || '>part' END AS types, CASE pos WHEN 0 THEN 'placed' ELSE 'placed>' || o_orderpriority END AS relations FROM orders CROSS JOIN (VALUES (0), (1)) p(pos)"""
ORACLES["templates_filled"] = """SELECT n_nationkey, id, hops AS num_hops, replace(replace(t, '<nation>', n_name), '<region>', r_name) AS question, own AS topic_types FROM nation JOIN region ON n_regionkey = r_regionkey CROSS JOIN
  (VALUES ('t1', 1, 'Which region has <nation>?', 'nation'), ('t2', 2, 'Who lives in <region>, say in <nation>?', 'region'), ('t3', 2, 'Segments of <nation> and <unknown>', 'nation')) v(id, hops, t, own)"""
ORACLES["keyed_last_wins"] = "SELECT CAST(user_id AS VARCHAR) AS data_id, arg_max(event_type, event_id) AS results FROM events GROUP BY user_id"
ORACLES["resume_anti_join"] = """SELECT CAST(c_custkey AS VARCHAR) AS data_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type <> 'error')
  AND NOT (c_nationkey = 3 AND c_custkey IN (SELECT user_id FROM events WHERE event_type = 'error'))"""
ORACLES["jsonl_roundtrip"] = f"""
WITH a AS (SELECT l_orderkey, string_agg(DISTINCT CAST(l_partkey + {4 * STRIDE} AS VARCHAR), ',' ORDER BY CAST(l_partkey + {4 * STRIDE} AS VARCHAR)) AS answers FROM lineitem GROUP BY l_orderkey)
SELECT CAST(o_orderkey AS VARCHAR) AS data_id, CASE WHEN o_orderstatus <> 'O' THEN 'asked' END AS query, ({2 * STRIDE} + o_custkey) || CASE WHEN o_orderstatus = 'P' THEN ',x' ELSE '' END AS topics,
  CASE WHEN o_orderstatus = 'F' THEN 'an order' END AS answer, answers, 2 AS num_hops FROM orders LEFT JOIN a ON l_orderkey = o_orderkey"""
ORACLES["generated_scores"] = f"""
WITH s AS (SELECT {STRIDE} + s_nationkey AS node, s_name, len(list_intersect(['which', 'supplier', '000000003'], list_distinct(regexp_extract_all(lower(s_name), '[a-z0-9]+')))) AS k FROM supplier),
t AS (SELECT node, s_name, format('{{:.4f}}', k / sum(k) OVER (PARTITION BY node)) AS said, count(*) OVER (PARTITION BY node) AS n FROM s),
u AS (SELECT node, s_name, n, CAST(said AS DOUBLE) AS x, bool_and(abs(CAST(said AS DOUBLE) - 1.0 / n) < 1e-6) OVER (PARTITION BY node) AS uniform, sum(CAST(said AS DOUBLE)) OVER (PARTITION BY node) AS total FROM t)
SELECT CAST(node AS BIGINT) AS node, CAST(n AS INTEGER) AS suppliers, string_agg(format('{{:.3f}}', CASE WHEN uniform THEN 1.0::DOUBLE / n ELSE x / total END), ' ' ORDER BY s_name) AS shares FROM u GROUP BY node, n"""
ORACLES["result_log_once"] = "SELECT CAST(c_custkey AS VARCHAR) AS data_id, c_mktsegment AS results FROM customer"
ORACLES["prompt_memo"] = """SELECT c_mktsegment, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '1.0000, 0.0000' WHEN 'BUILDING' THEN '0.0000, 1.0000' ELSE '0.5000, 0.5000' END AS response, count(*) AS customers, 1::BIGINT AS calls
FROM customer GROUP BY ALL"""


def own_bm25(items: str, by: str) -> str:
    """s(by, item, score): BM25 of items(q, by, item, text) among those of their group, against texts(q, text)."""
    return f"""texts AS (SELECT CAST(n_nationkey AS VARCHAR) AS q, 'small ring based_in: Supplier#' || lpad(CAST(n_nationkey AS VARCHAR), 9, '0') || ' lives nation. small' AS text FROM nation),
items AS MATERIALIZED ({items}),
words AS (SELECT *, string_split(text, ' ') AS w FROM items),
sizes AS (SELECT {by}, count(*) AS n, avg(len(w)) AS avg_len FROM words GROUP BY ALL),
post AS (SELECT {by}, item, len, term, count(*) AS tf FROM (SELECT {by}, item, len(w) AS len, unnest(w) AS term FROM words) GROUP BY ALL),
lex AS (SELECT {by}, term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post JOIN sizes USING ({by}) GROUP BY {by}, term),
idf AS (SELECT {by}, term, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY {by}) ELSE raw END AS idf FROM lex),
want AS (SELECT q, term, count(*) AS qf FROM (SELECT q, unnest(string_split(text, ' ')) AS term FROM texts) GROUP BY ALL),
hit AS (SELECT {by}, item, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 9) AS score FROM post JOIN sizes USING ({by}) JOIN idf USING ({by}, term) JOIN want USING (q, term) GROUP BY {by}, item),
s AS (SELECT {by}, item, coalesce(score, 0.0) AS score FROM items LEFT JOIN hit USING ({by}, item))"""


ORACLES["beam_bm25_sample"] = graph(
    "SELECT q AS question, relation, item AS entity, round(score, 6) AS raw FROM (SELECT *, count(*) OVER (PARTITION BY q, relation) AS n, row_number() OVER (PARTITION BY q, relation ORDER BY score DESC, item) AS k FROM s) WHERE n < 20 OR k <= 10",
    NATIONS,
    own_bm25("SELECT q, relation, entity AS item, name AS text FROM around JOIN nodes ON node_id = entity", "q, relation"),
)
ORACLES["beam_bm25_relations"] = graph(
    """SELECT q AS question, item AS relation, round(CASE WHEN n <= 3 THEN 1.0 / n WHEN sum(score) OVER (PARTITION BY q) = 0 THEN 1.0 / count(*) OVER (PARTITION BY q) ELSE score END, 6) AS score
FROM (SELECT *, count(*) OVER (PARTITION BY q) AS n, row_number() OVER (PARTITION BY q ORDER BY score DESC, item) AS k FROM s) WHERE k <= 3""",
    NATIONS,
    own_bm25("SELECT q, relation AS item, relation || ': ' || description AS text FROM (SELECT DISTINCT q, relation FROM around) JOIN rels USING (relation)", "q"),
)
