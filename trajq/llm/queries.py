"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trajq.llm import fingerprints, labelled, mixing, near, neighbours, packing, periodic, prefix_trie, quality, secret_scan, shards, tokens, toxicity, url_filter


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), end=2, vocabulary=50_257)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return labelled.graded(quality.score(docs, quality.fit(docs, labels(spark, sf_dir), of=3, held=1)), of=3, held=1)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return labelled.graded(toxicity.score(docs, toxicity.fit(docs, labels(spark, sf_dir), of=5, held=0)), of=5, held=0)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.clusters(documents(spark, sf_dir))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.digest(documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), end=1)


#: Rules of the registered url filter (fixed values).
RULES = [
    url_filter.Rule("net", "/", "block"),
    url_filter.Rule("example.net", "/en/", "allow"),
    url_filter.Rule("example.com", "/de/", "block"),
    url_filter.Rule("org", "/fr/", "allow"),
]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filtered(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.digest(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(documents(spark, sf_dir))


QUERIES = {
    "op1_token_ids": op1_token_ids,
    "op2_fingerprints": op2_fingerprints,
    "op3_quality": op3_quality,
    "op4_near_duplicates": op4_near_duplicates,
    "op9_neighbours": op9_neighbours,
    "op5_secrets": op5_secrets,
    "op6_mixing": op6_mixing,
    "op10_shards": op10_shards,
    "op8_toxicity": op8_toxicity,
    "op7_packing": op7_packing,
    "op11_url_filter": op11_url_filter,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_periodic_runs": op13_periodic_runs,
}

NEAR_SQL = r"""WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM t),
u AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) AS n, any_value(b.n) AS m FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p WHERE 100 * c >= 75 * (n + m - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS d, doc_id AS root FROM s UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.d),
m AS (SELECT d, min(root) AS component_id FROM r GROUP BY 1)
SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m ON m.d = s.doc_id"""

#: CRC-32 bit by bit, over the decimal digits of conv_id; a turn is its role's length, role and text.
TRIE_SQL = r"""WITH s AS (SELECT conv_id, list(struct_pack(e := strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''), b := strlen(coalesce(text, '')))
    ORDER BY turn NULLS FIRST, role NULLS FIRST) AS w FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295::BIGINT) % 9 AS h FROM s),
r AS (SELECT h.conv_id AS c, list_concat(coalesce(d.w[1:h.h], []), h.w[h.h + 1:]) AS w FROM h LEFT JOIN h d ON d.conv_id = h.conv_id - h.conv_id % 5),
m AS (SELECT c, len(w) AS last, d, w[1:d] AS p, w[1:d - 1] AS up, CASE WHEN d > 0 THEN w[d].b ELSE 0 END AS b FROM r, unnest(range(0, len(w) + 1)) AS u(d)),
n AS (SELECT d, p, any_value(up) AS up, min(c) AS low, count(*) AS k, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE last = d) AS ended FROM m GROUP BY d, p),
k AS (SELECT n.d, n.p, count(x.p) AS kids FROM n LEFT JOIN n x ON x.d = n.d + 1 AND x.up = n.p GROUP BY n.d, n.p),
f AS (SELECT m.c, m.d, m.p, sum(CASE WHEN m.c = n.low THEN 0 ELSE m.b END) OVER below AS saved, max(CASE WHEN k.kids = 0 AND m.c = n.low THEN 1 ELSE 0 END) OVER below AS leaf
    FROM m JOIN n ON n.d = m.d AND n.p = m.p JOIN k ON k.d = m.d AND k.p = m.p WINDOW below AS (PARTITION BY m.c ORDER BY m.d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
t AS (SELECT d, p, sum(saved) AS saved, sum(leaf) AS leaves FROM f GROUP BY d, p)
SELECT n.low AS conv_id, n.d AS depth, q.low AS parent_conv_id, n.k AS n_convs, k.kids AS n_children, t.leaves::BIGINT AS n_leaves, t.saved::BIGINT AS saved_tokens, sha256(coalesce(n.ended, '')) AS ends_sha256
FROM n JOIN k ON k.d = n.d AND k.p = n.p JOIN t ON t.d = n.d AND t.p = n.p LEFT JOIN n q ON q.d = n.d - 1 AND q.p = n.up"""

#: SQL of the queries that SQL can express on whole tables.
SQL: dict[str, str] = {"op4_near_duplicates": NEAR_SQL, "op12_prefix_trie": TRIE_SQL}
