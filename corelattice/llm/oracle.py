"""SQL for the queries of this subpackage, where SQL can say it on whole tables."""

CURRENT = "cur AS (SELECT * FROM adata_obs QUALIFY row_number() OVER (PARTITION BY cell_key ORDER BY loaded_at DESC) = 1)"
# the token rule as in packing.TOKEN
TOKENS = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f\x{85}\p{Z}]+'))"
VALUES = f"""{CURRENT},
vals AS (SELECT sample_id, pos, v FROM (SELECT sample_id, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS pos FROM cur WHERE sample_id IS NOT NULL)
         WHERE v IS NOT NULL AND NOT isnan(v))"""
PAIRS = f"""{CURRENT},
cells AS (SELECT cell_key, sample_id, trim(phenotype) AS spelt, CASE WHEN lower(trim(phenotype)) NOT IN ('', 'nan') THEN lower(trim(phenotype)) END AS plain FROM cur),
names AS (SELECT plain, spelt AS phenotype FROM (SELECT plain, spelt, count(*) AS c FROM cells WHERE plain IS NOT NULL GROUP BY 1, 2)
          QUALIFY row_number() OVER (PARTITION BY plain ORDER BY c DESC, spelt) = 1),
links AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM spatial_connectivities WHERE src <> dst AND (weight IS NULL OR weight <> 0)),
ends AS (SELECT cell_key, sample_id, phenotype FROM cells JOIN names USING (plain) WHERE sample_id IS NOT NULL),
met AS (SELECT x.sample_id, least(x.phenotype, y.phenotype) AS pa, greatest(x.phenotype, y.phenotype) AS pb
        FROM links JOIN ends x ON a = x.cell_key JOIN ends y ON b = y.cell_key WHERE x.sample_id = y.sample_id),
n AS (SELECT sample_id, pa, pb, count(*) AS n FROM met GROUP BY ALL),
d AS (SELECT sample_id, p, sum(n) AS d FROM (SELECT sample_id, pa AS p, n FROM n UNION ALL SELECT sample_id, pb, n FROM n) GROUP BY ALL),
mm AS (SELECT sample_id, sum(n) AS m FROM n GROUP BY 1),
assoc AS (SELECT n.sample_id, pa AS phenotype_a, pb AS phenotype_b, n.n::BIGINT AS n, m::BIGINT AS m, da.d::BIGINT AS d_a, db.d::BIGINT AS d_b
          FROM n JOIN mm USING (sample_id) JOIN d da ON da.sample_id = n.sample_id AND da.p = pa JOIN d db ON db.sample_id = n.sample_id AND db.p = pb)"""

# every pair of profiles, marker by marker: for tables that fit a brute-force check
_TERMS = " + ".join(f"coalesce((a.v{i} - b.v{i}) ** 2, 0)" for i in range(1, 17))
_PLACES = ", ".join(f"CASE WHEN x[{i}] > -1 AND NOT isnan(x[{i}]) THEN ln(1 + x[{i}]) END AS v{i}" for i in range(1, 17))
NEAREST = f"""{CURRENT},
p AS (SELECT * FROM (SELECT cell_key, {_PLACES} FROM cur WHERE x IS NOT NULL) WHERE coalesce({", ".join(f"v{i}" for i in range(1, 17))}) IS NOT NULL),
d AS (SELECT a.cell_key AS src, b.cell_key AS dst, {_TERMS} AS d2 FROM p a JOIN p b ON a.cell_key <> b.cell_key WHERE {_TERMS} <= 0.06::DOUBLE ** 2),
near AS (SELECT src, dst FROM d QUALIFY row_number() OVER (PARTITION BY src ORDER BY d2, dst) <= 5)"""

ORACLE = {
    "p5_found": f"WITH {NEAREST} SELECT DISTINCT least(src, dst) AS key_a, greatest(src, dst) AS key_b FROM near",
    "p3_found": f"""WITH {VALUES}
SELECT sample_id, name AS marker FROM (SELECT sample_id, pos, median(v) AS med FROM vals GROUP BY ALL) JOIN marker_var USING (pos)
WHERE med > 2 * expected_median OR med < 0.5 * expected_median""",
    "p3_percentiles": f"""WITH {VALUES},
q AS (SELECT sample_id, pos, count(*) AS n, quantile_cont(v, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q FROM vals GROUP BY ALL)
SELECT sample_id, name AS marker, n, percent, round(value, 6) AS value FROM
  (SELECT sample_id, pos, n, unnest([5.0::DOUBLE, 25, 50, 75, 95]) AS percent, unnest(q) AS value FROM q) JOIN marker_var USING (pos)""",
    "p4_found": f"""WITH {PAIRS}
SELECT sample_id, phenotype_a, phenotype_b FROM assoc WHERE phenotype_a <> phenotype_b AND n >= 8 AND 2.0 * m * n / (d_a * d_b) > 2.47""",
    "p4_pairs": f"""WITH {PAIRS}, r AS (SELECT *, (n + 0.5::DOUBLE) * (greatest(2 * m - d_a - d_b + n, 0) + 0.5::DOUBLE) / ((greatest(d_a - n, 0) + 0.5::DOUBLE) * (greatest(d_b - n, 0) + 0.5::DOUBLE)) AS o FROM assoc)
SELECT sample_id, phenotype_a, phenotype_b, n, m, d_a, d_b,
       round(CASE WHEN phenotype_a = phenotype_b THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END * m * n / (d_a::DOUBLE * d_b), 6) AS lift, round(o, 6) AS odds_ratio, round(ln(o), 6) AS log_odds FROM r""",
    "p6_found": f"""WITH s AS (SELECT doc_id, {TOKENS} AS size FROM documents)
SELECT doc_id, unnest(range(1, 1 + ceil(size / 1024.0)::BIGINT)) AS piece_no FROM s WHERE size > 1024""",
    "p6_fill_totals": f"""WITH s AS (SELECT {TOKENS} AS size FROM documents) SELECT sum(size)::BIGINT AS tokens, sum(ceil(size / 1024.0))::BIGINT AS pieces, 0::BIGINT AS overfull FROM s WHERE size > 0""",
    "p3_merged_error": f"""WITH {VALUES} SELECT 5 * count(*) AS percentiles, 0::BIGINT AS off FROM (SELECT DISTINCT sample_id, pos FROM vals JOIN marker_var USING (pos))""",
    # seats one by one by the highest quotients; no source beyond its cap
    "p7_quotas": f"""WITH s AS (SELECT regexp_replace(lower(trim(source)), '\\s+', ' ', 'g') AS s, {TOKENS} AS size FROM documents),
w AS (SELECT s, count(*) AS pages, sum(size)::BIGINT AS w FROM s GROUP BY 1), seats AS (SELECT sum(size)::BIGINT // 1024 AS n FROM s),
g AS (SELECT source, lower(source) AS s, target_share, max_repeats, coalesce(pages, 0) AS pages, coalesce(w, 0) AS available, coalesce(w, 0) * max_repeats AS capacity FROM mix_targets LEFT JOIN w ON w.s = lower(source)),
q AS (SELECT g.*, j, target_share / (2 * j + 1) AS quotient FROM (SELECT g.*, unnest(range(0, (SELECT n FROM seats))) AS j FROM g WHERE target_share > 0) g),
capped AS (SELECT s, count(*) AS blocks FROM (SELECT s FROM q WHERE j < ceil(capacity / 1024.0) ORDER BY quotient DESC, s LIMIT (SELECT n FROM seats)) GROUP BY 1),
free AS (SELECT s, count(*) AS uncapped FROM (SELECT s FROM q ORDER BY quotient DESC, s LIMIT (SELECT n FROM seats)) GROUP BY 1)
SELECT source, pages, available, capacity::BIGINT AS capacity, coalesce(blocks, 0) AS blocks, coalesce(uncapped, 0) AS uncapped FROM g LEFT JOIN capped USING (s) LEFT JOIN free USING (s)""",
    "p7_found": f"""WITH s AS (SELECT regexp_replace(lower(trim(source)), '\\s+', ' ', 'g') AS s, {TOKENS} AS size FROM documents),
g AS (SELECT s, sum(size) AS w FROM s GROUP BY 1)
SELECT source FROM mix_targets LEFT JOIN g ON s = lower(source)
WHERE coalesce(w, 0) * max_repeats < target_share * (SELECT sum(size) FROM s)""",
}
