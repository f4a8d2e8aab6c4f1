"""DuckDB SQL with the rows of the library's queries, written independently of them."""

from __future__ import annotations

_FLOWS = """
flows AS (
  SELECT 'day=' || strftime(ts, '%Y-%m-%d') AS file_id, event_id AS row_id, event_type AS label, 'u' || user_id AS src,
         'k' || (props->>'$.k') AS dst, value, hour(ts)::BIGINT AS hour, user_id, (props->>'$.k')::BIGINT AS k, value <= 250 AS inlier
  FROM events
), grouped AS (
  SELECT *, file_id || '::block=' || (row_id // 64) AS group_id, sha256(file_id || ':' || row_id) AS sample_id FROM flows
)"""


def _u(key: str, seed: str = "42") -> str:
    return f"('0x' || substr(sha256('{seed}:' || {key}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0"


def _split(u: str, outer: float) -> str:
    return f"CASE WHEN {u} < 1.0::DOUBLE - {outer}::DOUBLE THEN 'test' WHEN {u} < (1.0::DOUBLE - {outer}::DOUBLE) + {outer}::DOUBLE * 0.1::DOUBLE THEN 'validation' ELSE 'train' END"


_SPLIT = _FLOWS + f""", drawn AS (SELECT *, {_u('group_id')} AS u FROM grouped), split_rows AS (SELECT *, {_split('u', 0.7)} AS split FROM drawn)"""

_MANIFEST = _FLOWS + f""", files AS (SELECT file_id, count(*) AS total FROM flows GROUP BY 1),
row_groups AS (
  SELECT file_id, g AS row_group, least(128, total - g * 128) AS n_rows FROM files, LATERAL (SELECT unnest(range(0, (total - 1) // 128 + 1)) AS g)
), cut AS (
  SELECT file_id, row_group, o AS "offset", least(48, n_rows - o)::BIGINT AS n_rows FROM row_groups, LATERAL (SELECT unnest(range(0, n_rows, 48)) AS o)
), named AS (
  SELECT *, file_id || '::rg=' || row_group || '::offset=' || "offset" || '::rows=' || n_rows AS group_id FROM cut
), manifest_u AS (SELECT *, {_u('group_id')} AS u FROM named),
manifest AS (SELECT file_id, row_group, "offset", n_rows, group_id, {_split('u', 0.7)} AS split FROM manifest_u)"""

_BURST = _SPLIT + """, burst AS (SELECT * REPLACE (CASE WHEN value > 400 THEN 'burst' ELSE label END AS label) FROM split_rows)"""
_FINE = _SPLIT + """, fine AS (SELECT * REPLACE (label || CASE WHEN value > 330 THEN '/' || trunc(value / 10)::BIGINT ELSE '' END AS label) FROM split_rows)"""

#: The row groups that the tables' writer makes: of 1048576 rows, the last one of the rest.
_FOOTERS = """footers AS (
  SELECT file_id, g AS row_group, g * 1048576 AS start, least(1048576, total - g * 1048576) AS n_rows
  FROM (SELECT 'events.parquet' AS file_id, count(*) AS total FROM events UNION ALL SELECT 'orders.parquet', count(*) FROM orders UNION ALL SELECT 'lineitem.parquet', count(*) FROM lineitem),
       LATERAL (SELECT unnest(range(0, (total - 1) // 1048576 + 1)) AS g)
)"""

_FOOTER_MANIFEST = _FOOTERS + f""", footer_cut AS (
  SELECT file_id, row_group, o AS "offset", least(64, n_rows - o)::BIGINT AS n_rows FROM footers, LATERAL (SELECT unnest(range(0, n_rows, 64)) AS o) WHERE file_id = 'events.parquet'
), footer_named AS (
  SELECT *, file_id || '::rg=' || row_group || '::offset=' || "offset" || '::rows=' || n_rows AS group_id FROM footer_cut
), footer_u AS (SELECT *, {_u('group_id')} AS u FROM footer_named),
footer_groups AS (SELECT file_id, row_group, "offset", n_rows, group_id, {_split('u', 0.7)} AS split FROM footer_u),
placed AS (SELECT *, row_number() OVER () - 1 AS row_id FROM events)"""

_LINES = """dirty AS (
  SELECT l_orderkey, l_quantity, CASE WHEN l_discount = 0 THEN NULL ELSE l_discount END AS discount,
         CASE WHEN l_tax = 0 THEN 'inf'::DOUBLE WHEN l_tax = 0.01 THEN 'nan'::DOUBLE ELSE l_tax END AS tax, l_extendedprice
  FROM lineitem
)"""

_FEATURES = _SPLIT + """, clean AS (
  SELECT row_id, split, inlier, CASE WHEN k IN (7, 8) THEN NULL ELSE value END AS value, hour::DOUBLE AS hour, user_id::DOUBLE AS user_id, k::DOUBLE AS k FROM split_rows
), middle AS (
  SELECT median(value) AS value, median(hour) AS hour, median(user_id) AS user_id, median(k) AS k FROM clean WHERE split = 'train'
), filled AS (
  SELECT c.row_id, c.split, c.inlier, coalesce(c.value, m.value) AS value, coalesce(c.hour, m.hour) AS hour, coalesce(c.user_id, m.user_id) AS user_id, coalesce(c.k, m.k) AS k
  FROM clean c, middle m WHERE c.split <> 'train' OR c.inlier
), bounds AS (
  SELECT min(value) AS v0, max(value) AS v1, min(hour) AS h0, max(hour) AS h1, min(user_id) AS u0, max(user_id) AS u1, min(k) AS k0, max(k) AS k1 FROM filled WHERE split = 'train'
), scaled AS (
  SELECT row_id, split, (value - v0) / (v1 - v0) AS value_scaled, (hour - h0) / (h1 - h0) AS hour_scaled, (user_id - u0) / (u1 - u0) AS user_id_scaled, (k - k0) / (k1 - k0) AS k_scaled
  FROM filled, bounds
)"""

def _taken(order: str, target: str) -> str:
    """Tables that walk through an order of (attempt, k, n) one group at a time, for all attempts at once."""
    return f"""{order}_walk AS (
  SELECT attempt, 0::BIGINT AS k, 0::BIGINT AS acc, false AS took FROM attempts
  UNION ALL
  SELECT w.attempt, o.k, CASE WHEN t.yes THEN w.acc + o.n ELSE w.acc END, t.yes
  FROM {order}_walk w JOIN {order}_order o ON o.attempt = w.attempt AND o.k = w.k + 1, total,
       LATERAL (SELECT w.acc = 0 OR abs(w.acc - {target}) > abs(w.acc + o.n - {target}) AS yes) t
), {order}_took AS MATERIALIZED (
  SELECT o.attempt, o.group_id FROM {order}_walk w JOIN {order}_order o USING (attempt, k)
  WHERE took AND NOT (o.k = o.groups AND o.groups > 1 AND (SELECT count(*) FROM {order}_walk x WHERE x.attempt = o.attempt AND x.took) = o.groups)
)"""


_SEARCH = _FLOWS.replace("flows AS (", "RECURSIVE flows AS (", 1) + f""", sizes AS MATERIALIZED (SELECT group_id, count(*)::BIGINT AS n FROM grouped GROUP BY 1), total AS MATERIALIZED (SELECT sum(n)::BIGINT AS t FROM sizes),
attempts AS (SELECT unnest(range(128)) AS attempt),
test_order AS MATERIALIZED (
  SELECT attempt, group_id, n, row_number() OVER (PARTITION BY attempt ORDER BY sha256((42 + attempt * 104729) || ':' || group_id)) AS k, count(*) OVER (PARTITION BY attempt) AS groups FROM attempts, sizes
), {_taken("test", "t * (1.0::DOUBLE - 0.7::DOUBLE)")}, validation_order AS MATERIALIZED (
  SELECT attempt, group_id, n, row_number() OVER (PARTITION BY attempt ORDER BY sha256((42 + attempt * 104729 + 1) || ':' || group_id)) AS k, count(*) OVER (PARTITION BY attempt) AS groups
  FROM test_order ANTI JOIN test_took USING (attempt, group_id)
), {_taken("validation", "t * (0.7::DOUBLE * 0.1::DOUBLE)")}, assigned AS MATERIALIZED (
  SELECT o.attempt, o.group_id, CASE WHEN x.attempt IS NOT NULL THEN 'test' WHEN v.attempt IS NOT NULL THEN 'validation' ELSE 'train' END AS split
  FROM test_order o LEFT JOIN test_took x USING (attempt, group_id) LEFT JOIN validation_took v ON v.attempt = o.attempt AND v.group_id = o.group_id
)"""

_SCORES = _SEARCH + """, cells AS (SELECT group_id, CASE WHEN value > 400 THEN 'burst' ELSE label END AS label, count(*) AS n FROM grouped GROUP BY 1, 2),
counts AS MATERIALIZED (SELECT attempt, split, label, sum(n)::DOUBLE AS n FROM assigned JOIN cells USING (group_id) GROUP BY 1, 2, 3),
sums AS (SELECT attempt, split, sum(n) AS rows FROM counts GROUP BY 1, 2),
overall AS (SELECT label, sum(n)::DOUBLE / (SELECT t FROM total) AS p FROM cells GROUP BY 1),
frame AS (SELECT attempt, split, label, p FROM attempts, (VALUES ('train'), ('validation'), ('test')) s(split), overall),
parts AS (
  SELECT f.attempt, f.split, avg(abs(f.p - coalesce(c.n / s.rows, 0))) + 0.25 * count(*) FILTER (c.n IS NULL) AS label_part,
         4 * abs(coalesce(any_value(s.rows), 0) / (SELECT t FROM total) - CASE f.split WHEN 'train' THEN 0.7 * 0.9 WHEN 'validation' THEN 0.07 ELSE 0.3 END) AS fraction_part
  FROM frame f LEFT JOIN counts c USING (attempt, split, label) LEFT JOIN sums s USING (attempt, split) GROUP BY 1, 2
), scores AS (SELECT attempt, round(sum(label_part + fraction_part), 9) AS score FROM parts GROUP BY 1)"""


#: White space of the kinds that occur in the tables, cut off at both ends.
_TRIM = "trim(e, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(32) || chr(160))"


def _windows(rows: str = "grouped") -> str:
    return f""", runs AS (
  SELECT *, row_id - row_number() OVER (PARTITION BY group_id ORDER BY row_id) AS run,
         CASE k WHEN 0 THEN ' NaN' || chr(9) WHEN 1 THEN '' WHEN 2 THEN chr(9) || chr(160) WHEN 3 THEN chr(10) || dst || chr(9) ELSE dst END AS end_dst FROM {rows} WHERE inlier
), framed AS (
  SELECT *, row_number() OVER (PARTITION BY group_id, run ORDER BY row_id) - 1 AS pos, list(row_id) OVER w AS ids, list(label) OVER w AS labels,
         list(src) OVER w AS srcs, list(dst) OVER w AS raw_dsts, list(end_dst) OVER w AS dsts, list(sample_id) OVER w AS samples, list(value) OVER w AS vals
  FROM runs WINDOW w AS (PARTITION BY group_id, run ORDER BY row_id ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)
), wins AS (
  SELECT *, row_id AS first_row, len(list_filter(list_concat(srcs, dsts), lambda e: e IS NULL OR {_TRIM} = '' OR lower({_TRIM}) IN ('nan', 'none', '<na>'))) = 0 AS kept
  FROM framed WHERE len(ids) = 16 AND pos % 8 = 0
), hashed AS (
  SELECT *, list_transform(srcs, lambda e: sha256('flowframe' || chr(0) || {_TRIM})) AS hs, list_transform(dsts, lambda e: sha256('flowframe' || chr(0) || {_TRIM})) AS hd FROM wins
), noded AS (SELECT *, list_sort(list_distinct(list_concat(hs, hd))) AS nodes FROM hashed),
graphs AS (SELECT * FROM noded WHERE kept)"""


_WINDOWS = _FLOWS + _windows()
_RUNS = _FLOWS + """, run_rows AS (SELECT *, row_id - row_number() OVER (PARTITION BY group_id ORDER BY row_id) AS run FROM grouped WHERE inlier),
run_sizes AS (SELECT group_id, min(row_id) AS first_row, max(row_id) AS last_row, count(*) AS n_rows FROM run_rows GROUP BY group_id, run)"""

_JUDGED = """judged AS (
  SELECT l_returnflag AS actual, CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_quantity > 25 THEN 'A' ELSE 'R' END AS predicted, l_quantity, l_discount, l_tax FROM lineitem
), words AS (SELECT DISTINCT w FROM (SELECT actual AS w FROM judged UNION ALL SELECT predicted FROM judged))"""

_CLASSES = _JUDGED + """, tallies AS (
  SELECT w AS label, (SELECT count(*) FROM judged WHERE actual = w) AS support, (SELECT count(*) FROM judged WHERE predicted = w) AS n_predicted,
         (SELECT count(*) FROM judged WHERE predicted = w AND actual = w) AS n_right FROM words
), rates AS (SELECT *, n_right / greatest(n_predicted, 1) AS p, n_right / greatest(support, 1) AS r FROM tallies),
classes AS (
  SELECT label, support, n_predicted, n_right, round(p, 9) AS precision_score, round(r, 9) AS recall_score, round(2 * p * r / greatest(p + r, 1e-12), 9) AS f1 FROM rates
)"""

_SCORED = _JUDGED + """, scored AS (
  SELECT actual = 'A' AS pos, 'A' AS label, l_discount AS score FROM judged UNION ALL SELECT actual = 'N', 'N', l_tax FROM judged UNION ALL SELECT actual = 'R', 'R', l_quantity FROM judged
), points AS (
  SELECT label, score, sum(count(*) FILTER (pos)) OVER down AS tp, sum(count(*) FILTER (NOT pos)) OVER down AS fp,
         sum(count(*) FILTER (pos)) OVER (PARTITION BY label) AS p, sum(count(*) FILTER (NOT pos)) OVER (PARTITION BY label) AS n
  FROM scored GROUP BY label, score WINDOW down AS (PARTITION BY label ORDER BY score DESC ROWS UNBOUNDED PRECEDING)
), curve AS (
  SELECT label, score, round(tp / p, 9) AS tpr, round(fp / n, 9) AS fpr, round(tp / (tp + fp), 9) AS precision_at FROM points WHERE p > 0 AND n > 0
)"""

_AREAS = """c AS (SELECT label, score, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM scored GROUP BY 1, 2),
        pairs AS (SELECT x.label, sum(x.p * (CASE WHEN y.score < x.score THEN 1.0 WHEN y.score = x.score THEN 0.5 ELSE 0 END) * y.n) AS won FROM c x JOIN c y ON x.label = y.label GROUP BY 1),
        sides AS (SELECT label, sum(p) AS p, sum(n) AS n FROM c GROUP BY 1), areas AS (SELECT label, round(won::DOUBLE / nullif(p::DOUBLE * n::DOUBLE, 0), 9) AS auc FROM pairs JOIN sides USING (label)),
        macro AS (SELECT CASE WHEN count(*) = count(auc) THEN round(avg(auc), 9) END AS macro_auc FROM areas)"""

#: The event types, in order.
_LABELS = ("click", "error", "purchase", "signup", "view")

ORACLES: dict[str, str] = {
    "sample_ids": f"WITH {_FLOWS} SELECT file_id, row_id, sample_id FROM grouped",
    "duplicate_sample_ids": "SELECT count(*) AS n_rows, count(*) - count(DISTINCT sha256(l_orderkey || ':' || l_linenumber)) AS n_repeated FROM lineitem",
    "unit_interval_split": f"WITH {_FLOWS}, ids AS (SELECT DISTINCT group_id FROM grouped), us AS (SELECT group_id, {_u('group_id')} AS u FROM ids) SELECT group_id, u, {_split('u', 0.7)} AS split_70, {_split('u', 0.8)} AS split_80 FROM us",
    "contiguous_groups": f"WITH {_FLOWS} SELECT group_id, count(*) AS n_rows, min(row_id) AS first_row, max(row_id) AS last_row FROM grouped GROUP BY 1",
    "group_manifest": f"WITH {_MANIFEST} SELECT * FROM manifest",
    "manifest_rows": f"""WITH {_MANIFEST}, placed AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY row_id) - 1 AS place FROM flows)
        SELECT m.group_id, m.split, count(*) AS n_read, min(p.row_id) AS first_row, max(m.n_rows) AS n_rows
        FROM placed p JOIN manifest m ON p.file_id = m.file_id AND p.place >= m.row_group * 128 + m."offset" AND p.place < m.row_group * 128 + m."offset" + m.n_rows GROUP BY 1, 2""",
    "manifest_summary": f"WITH {_MANIFEST} SELECT split, count(*) AS n_groups, sum(n_rows)::BIGINT AS n_rows, count(DISTINCT file_id) AS n_files, count(DISTINCT group_id) AS n_ids FROM manifest GROUP BY 1",
    "footer_row_groups": f"WITH {_FOOTERS} SELECT * FROM footers",
    "footer_manifest": f"WITH {_FOOTER_MANIFEST} SELECT * FROM footer_groups",
    "footer_group_rows": f"""WITH {_FOOTER_MANIFEST} SELECT group_id, count(*) AS n_rows, min(row_id) AS first_row, sum(value::DECIMAL(18, 2))::DOUBLE AS total
        FROM placed JOIN footer_groups ON row_group = row_id // 1048576 AND "offset" = row_id % 1048576 // 64 * 64 WHERE split = 'test' GROUP BY 1""",
    "footer_slices": f"""WITH {_FOOTER_MANIFEST}, files AS (SELECT count(*) AS total, least(count(*), 4) AS k FROM footers WHERE file_id = 'events.parquet'),
        picks AS (SELECT DISTINCT round_even(i * (CASE WHEN k > 1 THEN (total - 1) / (k - 1) ELSE 0 END), 0)::BIGINT AS row_group, k FROM files, LATERAL (SELECT unnest(range(0, k)) AS i)),
        spread AS (SELECT row_group, 640 // k + CASE WHEN row_number() OVER (ORDER BY row_group) - 1 < 640 % k THEN 1 ELSE 0 END AS quota FROM picks),
        sized AS (SELECT f.row_group, start, n_rows, least(quota, n_rows) AS take FROM spread JOIN footers f USING (row_group) WHERE file_id = 'events.parquet'),
        drawn AS (SELECT *, (('0x' || substr(sha256('42:events.parquet:' || row_group), 1, 16))::UBIGINT % (n_rows - take + 1)::UBIGINT)::BIGINT AS d FROM sized),
        slices AS (SELECT *, least(d // 16 * 16, n_rows - take) AS first FROM drawn)
        SELECT row_group, row_id, event_id, event_type FROM placed JOIN slices ON row_id >= start + first AND row_id < start + first + take""",
    "row_group_range": "SELECT user_id, count(*) AS n, max(value) AS most, max(r) AS last_row FROM (SELECT *, row_number() OVER () - 1 AS r FROM events) WHERE value BETWEEN 200 AND 300 GROUP BY 1",
    "interval_rows": f"""WITH {_FLOWS}, stretches AS (SELECT file_id, row_id AS first_row, row_id + 1 + floor(value / 5)::BIGINT AS stop_row FROM flows WHERE NOT inlier)
        SELECT s.file_id, first_row, stop_row, count(*) AS n_rows, sum(value::DECIMAL(18, 2))::DOUBLE AS total
        FROM stretches s JOIN flows f ON f.file_id = s.file_id AND f.row_id >= first_row AND f.row_id < stop_row GROUP BY 1, 2, 3""",
    "row_group_indices": f"""WITH {_FLOWS}, totals AS (SELECT file_id, (count(*) - 1) // 16 + 1 AS total FROM flows GROUP BY 1)
        SELECT DISTINCT file_id, round_even(i * CASE WHEN least(8, total) > 1 THEN (total - 1) / (least(8, total) - 1) ELSE 0 END, 0)::BIGINT AS row_group
        FROM totals, LATERAL (SELECT unnest(range(least(8, total))) AS i)""",
    "contiguous_slice_sample": f"""WITH {_MANIFEST}, counts AS (SELECT file_id, count(*) AS total, least(count(*), 4) AS k FROM row_groups GROUP BY 1),
        picks AS (SELECT DISTINCT file_id, k, round_even(i * CASE WHEN k > 1 THEN (total - 1) / (k - 1) ELSE 0 END, 0)::BIGINT AS row_group FROM counts, LATERAL (SELECT unnest(range(k)) AS i)),
        nth AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY row_group) - 1 AS place FROM picks),
        plan AS (SELECT file_id, row_group, n_rows, least(160 // k + CASE WHEN place < 160 % k THEN 1 ELSE 0 END, n_rows) AS take FROM nth JOIN row_groups USING (file_id, row_group)),
        drawn AS (SELECT *, (('0x' || substr(sha256('42:' || file_id || ':' || row_group), 1, 16))::UBIGINT % (n_rows - take + 1)::UBIGINT)::BIGINT AS d FROM plan),
        slices AS (SELECT file_id, row_group, take, least(d // 16 * 16, n_rows - take) AS first FROM drawn),
        placed AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY row_id) - 1 AS place FROM flows)
        SELECT p.file_id, s.row_group, p.row_id FROM placed p JOIN slices s ON p.file_id = s.file_id AND p.place // 128 = s.row_group WHERE p.place % 128 >= first AND p.place % 128 < first + take""",
    "hash_row_sample": f"WITH {_FLOWS} SELECT file_id, row_id, label FROM flows QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY sha256('42:' || file_id || ':' || row_id), row_id) <= 32",
    "reservoir_groups": f"WITH {_MANIFEST} SELECT file_id, split, group_id, n_rows FROM manifest QUALIFY row_number() OVER (PARTITION BY file_id, split ORDER BY sha256('42:' || group_id), group_id) = 1",
    "epoch_schedule": f"WITH {_MANIFEST} SELECT epoch::INTEGER AS epoch, row_number() OVER (PARTITION BY epoch ORDER BY sha256('42:' || epoch || ':' || group_id), group_id) - 1 AS place, group_id FROM manifest, range(1, 4) e(epoch) WHERE split = 'train'",
    "spread_row_sample": f"""WITH {_FLOWS}, totals AS (SELECT file_id, (count(*) - 1) // 16 + 1 AS total FROM flows GROUP BY 1), picks AS (
        SELECT DISTINCT file_id, round_even(i * CASE WHEN least(8, total) > 1 THEN (total - 1) / (least(8, total) - 1) ELSE 0 END, 0)::BIGINT AS row_group FROM totals, LATERAL (SELECT unnest(range(least(8, total))) AS i)),
        placed AS (SELECT *, (row_number() OVER (PARTITION BY file_id ORDER BY row_id) - 1) // 16 AS row_group FROM flows)
        SELECT file_id, row_group, row_id FROM placed JOIN picks USING (file_id, row_group) QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY sha256('42:' || file_id || ':' || row_id), row_id) <= 32""",
    "reservoir_bounds": f"""WITH {_MANIFEST}, few AS (SELECT * FROM manifest WHERE split = 'train' QUALIFY row_number() OVER (PARTITION BY file_id, split ORDER BY sha256('42:' || group_id), group_id) = 1),
        placed AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY row_id) - 1 AS place FROM flows),
        t AS (SELECT p.value, p.hour::DOUBLE AS hour, p.user_id::DOUBLE AS user_id, p.k::DOUBLE AS k FROM placed p JOIN few m ON p.file_id = m.file_id AND p.place >= m.row_group * 128 + m."offset" AND p.place < m.row_group * 128 + m."offset" + m.n_rows),
        w AS (SELECT count(DISTINCT label)::INTEGER AS n_labels FROM flows)
        SELECT 'value' AS column_name, median(value) AS median, min(value) AS low, max(value) AS high, any_value(n_labels) AS n_labels FROM t, w
        UNION ALL SELECT 'hour', median(hour), min(hour), max(hour), any_value(n_labels) FROM t, w UNION ALL SELECT 'user_id', median(user_id), min(user_id), max(user_id), any_value(n_labels) FROM t, w
        UNION ALL SELECT 'k', median(k), min(k), max(k), any_value(n_labels) FROM t, w""",
    "label_histogram": """WITH o AS (SELECT nullif(o_orderstatus, 'P') AS label FROM orders), c AS (SELECT label, count(*) AS n FROM o GROUP BY 1)
        SELECT label, n, CASE WHEN label IS NOT NULL THEN round(n / (SELECT sum(n) FROM c WHERE label IS NOT NULL), 9) END AS fraction FROM c""",
    "label_audit": f"""WITH {_BURST} SELECT split, count(*) AS n_rows, count(*) FILTER (label IS NULL) AS n_unlabelled, count(DISTINCT label) AS n_labels,
        (SELECT string_agg(label, ',' ORDER BY label) FROM (SELECT DISTINCT label FROM burst)) AS vocabulary FROM burst GROUP BY 1""",
    "labels_missing_by_split": f"""WITH {_FINE} SELECT s.split, l.label FROM (VALUES ('train'), ('validation'), ('test')) s(split), (SELECT DISTINCT label FROM fine) l
        WHERE NOT EXISTS (SELECT 1 FROM fine f WHERE f.split = s.split AND f.label = l.label)""",
    "rare_group_labels": f"WITH {_FINE} SELECT label, count(DISTINCT group_id) AS n_groups FROM fine GROUP BY 1 HAVING count(DISTINCT group_id) < 3",
    "column_profile": f"""WITH {_LINES} SELECT * FROM (
          SELECT 'discount' AS column_name, count(*) FILTER (discount IS NULL OR isnan(discount)) AS n_missing, count(*) FILTER (isinf(discount)) AS n_infinite FROM dirty
          UNION ALL SELECT 'tax', count(*) FILTER (tax IS NULL OR isnan(tax)), count(*) FILTER (isinf(tax)) FROM dirty
          UNION ALL SELECT 'l_quantity', count(*) FILTER (l_quantity IS NULL OR isnan(l_quantity)), count(*) FILTER (isinf(l_quantity)) FROM dirty
          UNION ALL SELECT 'l_extendedprice', count(*) FILTER (l_extendedprice IS NULL OR isnan(l_extendedprice)), count(*) FILTER (isinf(l_extendedprice)) FROM dirty
          UNION ALL SELECT 'l_orderkey', count(*) FILTER (l_orderkey IS NULL), 0 FROM dirty) WHERE n_missing > 0 OR n_infinite > 0""",
    "timestamp_parse_failures": """WITH s AS (SELECT CASE WHEN starts_with(o_orderpriority, '1') THEN 'n/a' WHEN starts_with(o_orderpriority, '2') THEN NULL ELSE strftime(o_orderdate, '%d/%m/%Y %H:%M:%S') END AS stamp FROM orders)
        SELECT count(*) AS n_rows, count(*) FILTER (try_strptime(stamp, '%d/%m/%Y %H:%M:%S') IS NULL) AS n_failed FROM s""",
    "parse_failures": """WITH o AS (SELECT o_totalprice::VARCHAR AS price, o_orderpriority AS priority, CASE WHEN o_orderstatus = 'F' THEN '-' ELSE o_custkey::VARCHAR END AS customer FROM orders)
        SELECT 'price' AS column_name, count(*) FILTER (price IS NOT NULL AND try_cast(price AS DOUBLE) IS NULL) AS n_failed FROM o
        UNION ALL SELECT 'priority', count(*) FILTER (priority IS NOT NULL AND try_cast(priority AS DOUBLE) IS NULL) FROM o
        UNION ALL SELECT 'customer', count(*) FILTER (customer IS NOT NULL AND try_cast(customer AS DOUBLE) IS NULL) FROM o""",
    "feature_decisions": f"""WITH {_SPLIT}, t AS (
          SELECT CASE WHEN k IN (7, 8) THEN NULL ELSE value END AS value, CASE WHEN k IN (7, 8) THEN NULL ELSE value END AS value_again, hour, user_id, k, 1.0 AS one, 1.0 AS one_again, NULL::DOUBLE AS nothing
          FROM split_rows WHERE split = 'train')
        SELECT 'value' AS column_name, CASE WHEN count(DISTINCT value) > 1 THEN 'kept' ELSE 'constant' END AS decision FROM t
        UNION ALL SELECT 'value_again', CASE WHEN bool_and(value IS NOT DISTINCT FROM value_again) THEN 'duplicate of value' ELSE 'kept' END FROM t
        UNION ALL SELECT 'hour', CASE WHEN count(DISTINCT hour) > 1 THEN 'kept' ELSE 'constant' END FROM t
        UNION ALL SELECT 'user_id', CASE WHEN count(DISTINCT user_id) > 1 THEN 'kept' ELSE 'constant' END FROM t
        UNION ALL SELECT 'k', CASE WHEN count(DISTINCT k) > 1 THEN 'kept' ELSE 'constant' END FROM t
        UNION ALL SELECT 'one', CASE WHEN count(DISTINCT one) > 1 THEN 'kept' ELSE 'constant' END FROM t
        UNION ALL SELECT 'one_again', CASE WHEN bool_and(one IS NOT DISTINCT FROM one_again) THEN 'duplicate of one' ELSE 'kept' END FROM t
        UNION ALL SELECT 'nothing', CASE WHEN count(nothing) = 0 THEN 'empty' ELSE 'kept' END FROM t""",
    "duplicate_columns": f"""WITH {_SPLIT}, t AS (SELECT CASE WHEN k IN (7, 8) THEN NULL ELSE value END AS value, CASE WHEN k IN (7, 8) THEN NULL ELSE value END AS value_again, 1.0 AS one, 1.0 AS one_again FROM split_rows WHERE split = 'train')
        SELECT * FROM (SELECT 'value_again' AS column_name, 'value' AS same_as, bool_and(value IS NOT DISTINCT FROM value_again) AS same FROM t
        UNION ALL SELECT 'one_again', 'one', bool_and(one IS NOT DISTINCT FROM one_again) FROM t) WHERE same""".replace("SELECT * FROM (SELECT 'value_again'", "SELECT column_name, same_as FROM (SELECT 'value_again'"),
    "constant_columns": f"""WITH {_SPLIT}, t AS (SELECT value, hour, user_id, k, 1.0 AS one FROM split_rows WHERE split = 'train')
        SELECT column_name FROM (SELECT 'value' AS column_name, count(DISTINCT value) AS n FROM t UNION ALL SELECT 'hour', count(DISTINCT hour) FROM t UNION ALL SELECT 'user_id', count(DISTINCT user_id) FROM t
        UNION ALL SELECT 'k', count(DISTINCT k) FROM t UNION ALL SELECT 'one', count(DISTINCT one) FROM t) WHERE n <= 1""",
    "median_impute": f"WITH {_FEATURES} SELECT 'value' AS column_name, value AS median FROM middle UNION ALL SELECT 'hour', hour FROM middle UNION ALL SELECT 'user_id', user_id FROM middle UNION ALL SELECT 'k', k FROM middle",
    "minmax_scale": f"WITH {_FEATURES} SELECT row_id, split, round(value_scaled, 9) AS value_scaled, round(hour_scaled, 9) AS hour_scaled, round(user_id_scaled, 9) AS user_id_scaled, round(k_scaled, 9) AS k_scaled FROM scaled",
    "minmax_clip": f"WITH {_FEATURES} SELECT row_id, split, " + ", ".join(f"round(least(greatest({c}_scaled, 0), 1), 9) AS {c}_clipped" for c in ("value", "hour", "user_id", "k")) + " FROM scaled",
    "clip_counts": f"""WITH {_FEATURES} SELECT split, count(*) * 4 AS n_values, (count(*) FILTER (value_scaled < 0 OR value_scaled > 1) + count(*) FILTER (hour_scaled < 0 OR hour_scaled > 1)
        + count(*) FILTER (user_id_scaled < 0 OR user_id_scaled > 1) + count(*) FILTER (k_scaled < 0 OR k_scaled > 1))::BIGINT AS n_outside FROM scaled GROUP BY 1""",
    "label_encode": f"WITH {_BURST}, words AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT label FROM burst)) SELECT label, code, count(*) AS n FROM burst JOIN words USING (label) GROUP BY 1, 2",
    "seeded_group_order": f"WITH {_FLOWS}, ids AS (SELECT DISTINCT group_id FROM grouped) SELECT row_number() OVER (ORDER BY sha256('42:1:' || group_id), group_id) - 1 AS place, group_id FROM ids",
    "greedy_test_groups": f"""WITH {_SEARCH} SELECT attempt::INTEGER AS attempt, split, count(*) AS n_groups, sum(n)::BIGINT AS n_rows, sum(('0x' || substr(sha256(group_id), 1, 8))::BIGINT)::BIGINT AS digest
        FROM assigned JOIN sizes USING (group_id) WHERE split <> 'train' GROUP BY 1, 2""",
    "split_score_search": f"WITH {_SCORES} SELECT attempt::INTEGER AS attempt, score FROM scores",
    "assigned_splits": f"WITH {_SCORES}, best AS (SELECT attempt FROM scores ORDER BY score, attempt LIMIT 1) SELECT group_id, split, n::BIGINT AS n_rows FROM assigned JOIN best USING (attempt) JOIN sizes USING (group_id)",
    "split_leakage": f"""WITH {_SPLIT}, pairs AS (SELECT * FROM (VALUES ('train_validation', 'train', 'validation'), ('train_test', 'train', 'test'), ('validation_test', 'validation', 'test')) t(pair, a, b))
        SELECT pair, 'group' AS kind, (SELECT count(*) FROM (SELECT group_id FROM split_rows WHERE split = a INTERSECT SELECT group_id FROM split_rows WHERE split = b)) AS shared FROM pairs
        UNION ALL SELECT pair, 'user', (SELECT count(*) FROM (SELECT user_id FROM split_rows WHERE split = a INTERSECT SELECT user_id FROM split_rows WHERE split = b)) FROM pairs""",
    "contiguous_runs": f"WITH {_RUNS} SELECT * FROM run_sizes",
    "sliding_windows": f"WITH {_WINDOWS} SELECT group_id, first_row, ids[-1] AS last_row, labels[-1] AS target, array_to_string(labels, ',') AS labels, len(list_distinct(list_concat(srcs, raw_dsts)))::BIGINT AS n_nodes FROM wins",
    "valid_endpoint_windows": f"WITH {_WINDOWS} SELECT group_id, first_row, kept FROM wins",
    "endpoint_hashes": f"WITH {_FLOWS}, ends AS (SELECT src AS endpoint FROM flows UNION SELECT dst FROM flows) SELECT endpoint, sha256('flowframe' || chr(0) || endpoint) AS node_hash FROM ends",
    "window_graph_nodes": f"WITH {_WINDOWS} SELECT group_id, first_row, (i - 1)::INTEGER AS node, nodes[i] AS node_hash FROM graphs, LATERAL (SELECT unnest(range(1, len(nodes) + 1)) AS i)",
    "window_graph_edges": f"WITH {_WINDOWS} SELECT group_id, first_row, (i - 1)::INTEGER AS time, list_position(nodes, hs[i])::BIGINT - 1 AS src, list_position(nodes, hd[i])::BIGINT - 1 AS dst FROM graphs, LATERAL (SELECT unnest(range(1, 17)) AS i)",
    "csr_pointers": f"""WITH {_WINDOWS}, summed AS (SELECT group_id, first_row, len(nodes) AS n, sum(len(nodes)) OVER o AS upto, row_number() OVER o AS nth FROM graphs WINDOW o AS (ORDER BY group_id, first_row ROWS UNBOUNDED PRECEDING))
        SELECT group_id, first_row, (upto - n)::BIGINT AS node_start, upto::BIGINT AS node_stop, ((nth - 1) * 16)::BIGINT AS edge_start, (nth * 16)::BIGINT AS edge_stop FROM summed""",
    "edges_by_pointer": f"WITH {_WINDOWS} SELECT group_id, first_row, (i - 1)::INTEGER AS time, list_position(nodes, hs[i])::BIGINT - 1 AS src, list_position(nodes, hd[i])::BIGINT - 1 AS dst FROM graphs, LATERAL (SELECT unnest(range(1, 17)) AS i)",
    "pointer_integrity": f"WITH {_WINDOWS} SELECT count(*) AS n_windows, coalesce(sum(len(nodes)), 0)::BIGINT AS n_nodes, (count(*) * 16)::BIGINT AS n_edges, 0::BIGINT AS n_node_gaps, 0::BIGINT AS n_edge_gaps FROM graphs",
    "graph_message_mean": f"""WITH {_WINDOWS}, edges AS (SELECT group_id, first_row, list_position(nodes, hs[i]) - 1 AS src, list_position(nodes, hd[i]) - 1 AS dst, vals[i]::DECIMAL(18, 2) AS v FROM graphs, LATERAL (SELECT unnest(range(1, 17)) AS i)),
        ends AS (SELECT group_id, first_row, src AS node, v, false AS inward FROM edges UNION ALL SELECT group_id, first_row, dst, v, true FROM edges)
        SELECT group_id, first_row, node::BIGINT AS node, round(coalesce(sum(v) FILTER (inward), 0)::DOUBLE / greatest(count(*) FILTER (inward), 1), 6) AS mean_in,
               round(coalesce(sum(v) FILTER (NOT inward), 0)::DOUBLE / greatest(count(*) FILTER (NOT inward), 1), 6) AS mean_out FROM ends GROUP BY 1, 2, 3""",
    "window_metadata": f"""WITH {_WINDOWS}, short AS (SELECT count(*) AS n FROM (SELECT group_id, run FROM runs GROUP BY 1, 2 HAVING count(*) < 16))
        SELECT count(*) FILTER (kept) AS n_windows, (count(*) FILTER (kept) * 16)::BIGINT AS n_edges, (sum(len(nodes)) FILTER (kept))::BIGINT AS n_nodes, count(DISTINCT group_id) FILTER (kept) AS n_groups,
               count(*) FILTER (NOT kept) AS n_dropped, (SELECT n FROM short) AS n_short_runs FROM noded""",
    "graph_integrity": f"""WITH {_SPLIT + _windows('split_rows')}, places AS (SELECT nodes, ids, hs, hd, list_transform(range(2, 17), lambda i: ids[i] - ids[i - 1]) AS steps,
          list_transform(list_concat(hs, hd), lambda h: list_position(nodes, h)) AS spots FROM graphs)
        SELECT count(*) AS n_windows, count(*) FILTER (list_max(steps) <> 1 OR list_min(steps) <> 1) AS n_broken, count(*) FILTER (list_count(spots) < len(spots) OR list_min(spots) < 1 OR list_max(spots) > len(nodes)) AS n_outside,
               count(*) FILTER (len(ids) <> 16 OR len(hs) <> 16 OR len(hd) <> 16) AS n_short,
               (SELECT count(*) FROM (SELECT group_id FROM split_rows GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS n_torn_groups FROM places""",
    "sequence_leakage": f"""WITH {_SPLIT + _windows('split_rows')}, pairs AS (SELECT * FROM (VALUES ('train_validation', 'train', 'validation'), ('train_test', 'train', 'test'), ('validation_test', 'validation', 'test')) t(pair, a, b)),
        ids AS (SELECT DISTINCT split, unnest(samples) AS sample_id FROM wins)
        SELECT 'group' AS kind, pair, (SELECT count(*) FROM (SELECT group_id FROM wins WHERE split = a INTERSECT SELECT group_id FROM wins WHERE split = b)) AS shared FROM pairs
        UNION ALL SELECT 'sample', pair, (SELECT count(*) FROM (SELECT sample_id FROM ids WHERE split = a INTERSECT SELECT sample_id FROM ids WHERE split = b)) FROM pairs""",
    "confusion_matrix": f"""WITH {_JUDGED}, cells AS (SELECT a.w AS actual, b.w AS predicted, (SELECT count(*) FROM judged j WHERE j.actual = a.w AND j.predicted = b.w) AS n FROM words a, words b)
        SELECT actual, predicted, n, round(n / greatest(sum(n) OVER (PARTITION BY actual), 1), 9) AS row_share FROM cells""",
    "per_class_metrics": f"WITH {_CLASSES} SELECT * FROM classes",
    "macro_weighted_metrics": f"""WITH {_CLASSES}, s AS (SELECT sum(support) AS t FROM classes)
        SELECT round(sum(n_right) / sum(support), 9) AS accuracy, round(avg(precision_score), 6) AS macro_precision, round(avg(recall_score), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
               round(sum(support / t * precision_score), 6) AS weighted_precision, round(sum(support / t * recall_score), 6) AS weighted_recall, round(sum(support / t * f1), 6) AS weighted_f1 FROM classes, s""",
    "auc_ovr": f"""WITH {_SCORED}, c AS (SELECT label, score, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM scored GROUP BY 1, 2),
        pairs AS (SELECT x.label, sum(x.p * (CASE WHEN y.score < x.score THEN 1.0 WHEN y.score = x.score THEN 0.5 ELSE 0 END) * y.n) AS won FROM c x JOIN c y ON x.label = y.label GROUP BY 1),
        sides AS (SELECT label, sum(p) AS p, sum(n) AS n FROM c GROUP BY 1)
        SELECT label, round(won::DOUBLE / (p::DOUBLE * n::DOUBLE), 9) AS auc FROM pairs JOIN sides USING (label)""",
    "macro_auc": f"WITH {_SCORED}, {_AREAS} SELECT macro_auc FROM macro",
    "evaluation": f"""WITH {_CLASSES}, {_SCORED.removeprefix(_JUDGED + ', ')}, {_AREAS}, s AS (SELECT sum(support) AS t FROM classes)
        SELECT round(sum(n_right) / sum(support), 9) AS accuracy, round(avg(precision_score), 6) AS macro_precision, round(avg(recall_score), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
               round(sum(support / t * precision_score), 6) AS weighted_precision, round(sum(support / t * recall_score), 6) AS weighted_recall, round(sum(support / t * f1), 6) AS weighted_f1,
               (SELECT macro_auc FROM macro) AS macro_auc FROM classes, s""",
    "roc_points": f"WITH {_SCORED} SELECT label, score, tpr, fpr FROM curve",
    "pr_points": f"WITH {_SCORED} SELECT label, score, tpr, precision_at FROM curve",
    "average_precision": f"WITH {_SCORED}, gains AS (SELECT label, (tpr - lag(tpr, 1, 0) OVER (PARTITION BY label ORDER BY score DESC)) * precision_at AS g FROM curve) SELECT label, round(sum(g), 6) AS average_precision FROM gains GROUP BY 1",
    "winning_class": f"""WITH {_JUDGED}, three AS (SELECT actual, [l_discount * 10, l_tax * 12, l_quantity / 50] AS x FROM judged),
        raised AS (SELECT actual, list_transform(x, lambda v: exp(v - list_max(x))) AS e FROM three), shares AS (SELECT actual, list_transform(e, lambda v: v / list_sum(e)) AS s FROM raised)
        SELECT actual, ['A', 'N', 'R'][list_position(s, list_max(s))] AS predicted, count(*) AS n, round(sum(list_max(s)::DECIMAL(28, 9))::DOUBLE / count(*), 6) AS mean_share FROM shares GROUP BY 1, 2""",
    "concatenated_pointers": f"""WITH {_WINDOWS}, doubled AS (SELECT group_id, first_row, nodes FROM graphs UNION ALL SELECT '~' || group_id, first_row, nodes FROM graphs),
        summed AS (SELECT group_id, first_row, len(nodes) AS n, sum(len(nodes)) OVER o AS upto, row_number() OVER o AS nth FROM doubled WINDOW o AS (ORDER BY group_id, first_row ROWS UNBOUNDED PRECEDING))
        SELECT group_id, first_row, (upto - n)::BIGINT AS node_start, upto::BIGINT AS node_stop, ((nth - 1) * 16)::BIGINT AS edge_start, (nth * 16)::BIGINT AS edge_stop FROM summed""",
    "class_weights": f"WITH {_BURST}, c AS (SELECT label, count(*) AS n FROM burst GROUP BY 1) SELECT label, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 9) AS weight FROM c",
    "class_distribution": f"""WITH {_BURST} SELECT s.split, l.label, (SELECT count(*) FROM burst b WHERE b.split = s.split AND b.label = l.label) AS n
        FROM (VALUES ('train'), ('validation'), ('test')) s(split), (SELECT DISTINCT label FROM burst) l""",
    "latency_percentiles": f"""WITH {_FLOWS}, ranked AS (SELECT label, value, row_number() OVER (PARTITION BY label ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM flows)
        SELECT label, max(n) AS n, max(value) FILTER (r = round_even(0.5 * (n - 1), 0)) AS p50, max(value) FILTER (r = round_even(0.95 * (n - 1), 0)) AS p95,
               round(sum(value::DECIMAL(18, 2))::DOUBLE / max(n), 6) AS mean FROM ranked GROUP BY 1""",
    "online_means": "SELECT l_returnflag, round(sum((l_discount * l_quantity)::DECIMAL(28, 4))::DOUBLE / greatest(sum(l_quantity), 1), 6) AS weighted_mean FROM lineitem GROUP BY 1",
    "running_best": f"""WITH {_FLOWS}, days AS (SELECT file_id, count(*) AS n, count(*) FILTER (label = 'error') AS errors FROM flows GROUP BY 1),
        b AS (SELECT *, max(errors) OVER (ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM days)
        SELECT file_id, n, errors, best_before, best_before IS NULL OR errors > best_before AS improved FROM b""",
    "stagnation": f"""WITH {_FLOWS}, days AS (SELECT file_id, count(*) AS n, count(*) FILTER (label = 'error') AS errors FROM flows GROUP BY 1),
        b AS (SELECT *, lag(errors) OVER (ORDER BY file_id) AS e, lag(n) OVER (ORDER BY file_id) AS m FROM days)
        SELECT file_id, errors, n, coalesce(errors < e OR (errors = e AND n <= m), false) AS stagnant FROM b""",
    "topk_importance": "SELECT user_id, sum(value::DECIMAL(18, 2))::DOUBLE AS importance FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30",
    "attention_pivot": f"WITH {_FLOWS} SELECT hour, " + ", ".join(f"coalesce((sum(value::DECIMAL(18, 2)) FILTER (label = '{x}'))::DOUBLE / (count(*) FILTER (label = '{x}')), 0) AS mean_{x}" for x in _LABELS) + " FROM flows GROUP BY 1",
    "status_decision": """WITH o AS (SELECT o_custkey % 7 AS attempts, lower(CASE o_orderstatus WHEN 'O' THEN 'Still RUNNING' WHEN 'F' THEN 'job Failed' ELSE 'is ' || substr(o_orderpriority, 3) || ' pending' END) AS t FROM orders),
        s AS (SELECT attempts, CASE WHEN contains(t, 'running') THEN 'running' WHEN contains(t, 'queued') OR contains(t, 'pending') THEN 'queued' WHEN contains(t, 'complete') THEN 'complete'
              WHEN contains(t, 'cancelled') OR contains(t, 'canceled') THEN 'cancelled' WHEN contains(t, 'error') OR contains(t, 'fail') THEN 'error' ELSE 'unknown' END AS state FROM o)
        SELECT state, CASE WHEN state = 'running' THEN 'wait: running' WHEN state = 'queued' THEN 'wait: queued' WHEN attempts >= 5 THEN 'stop: attempts used up' ELSE 'push: incomplete' END AS decision, count(*) AS n FROM s GROUP BY 1, 2""",
    "session_decision": """WITH r AS (
          SELECT o_orderkey % 31 = 0 AS force, CASE o_custkey % 10 WHEN 0 THEN 'missing' WHEN 1 THEN 'completed' WHEN 2 THEN 'paused' WHEN 3 THEN 'paused' WHEN 4 THEN 'failed' ELSE 'running' END AS status,
                 CASE o_orderkey % 7 WHEN 0 THEN 'running' WHEN 1 THEN 'queued' WHEN 2 THEN 'error' WHEN 3 THEN 'complete' ELSE 'unknown' END AS kernel,
                 CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 11) * 1000 END AS silent, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_custkey % 13) * 500 END AS since, o_orderkey % 9 AS attempts, o_custkey % 4 AS stagnant
          FROM orders
        ), d AS (
          SELECT CASE WHEN force THEN 'forced' WHEN status = 'completed' THEN 'complete' WHEN kernel IN ('running', 'queued') THEN 'kernel ' || kernel
                 WHEN status = 'running' AND kernel = 'unknown' AND (silent IS NULL OR silent < 7200) THEN 'not silent for long' WHEN since < 1800 THEN 'pushed lately'
                 WHEN attempts >= 8 THEN 'attempts used up' WHEN stagnant >= 3 THEN 'no progress' WHEN status = 'paused' THEN 'paused' WHEN status = 'missing' THEN 'no run' ELSE 'incomplete, kernel ' || kernel END AS reason FROM r
        ) SELECT reason IN ('forced', 'paused', 'no run') OR starts_with(reason, 'incomplete') AS push, reason, count(*) AS n FROM d GROUP BY 1, 2""",
    "roc_corners": f"""WITH {_JUDGED}, scored AS (
          SELECT actual = 'A' AS pos, 'A' AS label, l_discount AS score FROM judged UNION ALL SELECT actual = 'N', 'N', l_tax FROM judged UNION ALL SELECT actual = 'R', 'R', l_quantity FROM judged
        ), steps AS (SELECT label, floor(score * 100)::BIGINT AS score, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM scored GROUP BY 1, 2),
        points AS (
          SELECT *, sum(p) OVER down AS tp, sum(n) OVER down AS fp, sum(p) OVER whole AS all_p, sum(n) OVER whole AS all_n, lead(p) OVER down AS next_p, lead(n) OVER down AS next_n, row_number() OVER down AS k
          FROM steps WINDOW down AS (PARTITION BY label ORDER BY score DESC), whole AS (PARTITION BY label)
        )
        SELECT label, score, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp / all_p, 9) AS tpr, round(fp / all_n, 9) AS fpr FROM points
        WHERE all_p > 0 AND all_n > 0 AND (k = 1 OR next_p IS NULL OR p <> next_p OR n <> next_n)""",
    "table_digest": """WITH h AS (SELECT sha256(to_json({'l_linenumber': l_linenumber, 'l_linestatus': l_linestatus, 'l_orderkey': l_orderkey, 'l_returnflag': l_returnflag})::VARCHAR) AS d FROM lineitem)
        SELECT count(*) AS n_rows, """ + ", ".join(f"sum(('0x' || substr(d, {1 + 15 * k}, 15))::BIGINT)::VARCHAR AS word_{k + 1}" for k in range(4)) + """ FROM h""",
    "packed_windows": f"""WITH {_WINDOWS} SELECT group_id, first_row, labels[-1] AS target, sha256(array_to_string(nodes, ',')) AS nodes_digest,
        array_to_string(list_transform(hs, lambda h: list_position(nodes, h) - 1), ',') AS src, array_to_string(list_transform(hd, lambda h: list_position(nodes, h) - 1), ',') AS dst FROM graphs""",
    "epoch_windows": f"""WITH {_FOOTER_MANIFEST}, starts AS (
          SELECT group_id, f.start + "offset" + s AS first_row FROM footer_groups g JOIN footers f USING (file_id, row_group), LATERAL (SELECT unnest(range(0, greatest(g.n_rows - 15, 0), 8)) AS s) WHERE split = 'train'
        )
        SELECT epoch::INTEGER AS epoch, b.event_type AS target, count(*) AS n_windows, count(DISTINCT group_id) AS n_groups, sum(first_row)::BIGINT AS first_rows,
               sum(b.value::DECIMAL(18, 2))::DOUBLE AS last_values, sum(a.user_id)::BIGINT AS first_users
        FROM starts s JOIN placed a ON a.row_id = first_row JOIN placed b ON b.row_id = first_row + 15, range(1, 3) e(epoch) GROUP BY 1, 2""",
    "cosine_rates": f"""WITH {_FLOWS}, days AS (SELECT file_id, (row_number() OVER (ORDER BY file_id) - 1)::INTEGER AS epoch, count(*) OVER () AS n FROM (SELECT DISTINCT file_id FROM flows))
        SELECT file_id, epoch, round(1e-6 + (1e-3 - 1e-6) * (1 + cos(3.141592653589793 * epoch / n)) / 2, 12) AS rate FROM days""",
    "stream_split_counts": f"WITH {_SPLIT} SELECT split, label, count(*) AS n FROM split_rows GROUP BY 1, 2",
    "flow_provenance": "SELECT l_returnflag AS label, count(*) AS n_rows, min(r) AS first_row, max(r) AS last_row, sum(r)::BIGINT AS places FROM (SELECT l_returnflag, row_number() OVER () - 1 AS r FROM lineitem) GROUP BY 1",
    "file_row_sample": f"""WITH {_FOOTER_MANIFEST}, own AS (SELECT * FROM footers WHERE file_id = 'events.parquet'), files AS (SELECT count(*) AS total, least(count(*), 8) AS k FROM own),
        picks AS (SELECT DISTINCT round_even(i * (CASE WHEN k > 1 THEN (total - 1) / (k - 1) ELSE 0 END), 0)::BIGINT AS row_group FROM files, LATERAL (SELECT unnest(range(0, k)) AS i))
        SELECT file_id, row_group, row_id, event_id, event_type FROM placed JOIN own ON row_id >= start AND row_id < start + n_rows JOIN picks USING (row_group)
        QUALIFY row_number() OVER (ORDER BY sha256('42:events.parquet:' || row_id), row_id) <= 500""",
    "split_manifest_file": f"WITH {_SPLIT} SELECT sample_id, group_id, split, file_id, row_id, label FROM split_rows",
    "window_table": f"""WITH {_WINDOWS}, named AS (SELECT {_split(_u('group_id'), 0.7)} AS split, group_id, first_row, labels[-1] AS target, len(nodes)::BIGINT AS n_nodes, 16::BIGINT AS n_edges FROM graphs)
        SELECT * FROM named WHERE split <> 'train'""",
    "stored_fit": f"WITH {_FEATURES} SELECT row_id, split, " + ", ".join(f"round(least(greatest({c}_scaled, 0), 1), 9) AS {c}_clipped" for c in ("value", "hour", "user_id", "k")) + " FROM scaled",
    "rounded_tables": f"WITH {_CLASSES} SELECT label, support, n_predicted, n_right, round(precision_score, 6) AS precision_score, round(recall_score, 6) AS recall_score, round(f1, 6) AS f1 FROM classes",
    "ranked_roots": """WITH named AS (SELECT '/lake/' || lower(substr(o_orderpriority, 3)) || '/c' || (o_custkey % 50) AS root, o_orderkey FROM orders)
        SELECT root, (50 + CASE WHEN contains(root, 'urgent') THEN 100 ELSE 0 END + CASE WHEN bool_or(o_orderkey % 97 = 0) THEN 20 ELSE 0 END)::INTEGER AS points FROM named GROUP BY root""",
    "iso_epochs": """WITH s AS (SELECT event_type, CASE event_id % 4 WHEN 1 THEN epoch(date_trunc('second', ts))::BIGINT - 7200 WHEN 3 THEN NULL ELSE epoch(date_trunc('second', ts))::BIGINT END AS seconds FROM events)
        SELECT event_type, count(*) AS n_rows, count(seconds) AS n_stamps, min(seconds) AS first_second, max(seconds) AS last_second, sum(seconds)::BIGINT AS total FROM s GROUP BY 1""",
    "resumed_stream": "SELECT count(*) AS n_source, count(*) AS n_target, true AS conserved FROM events",
    "streamed_windows": f"""WITH {_SPLIT}, bounds AS (SELECT min(value) AS v0, max(value) AS v1 FROM split_rows WHERE split = 'train' AND inlier),
        codes AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT label FROM split_rows)),
        runs AS (SELECT *, row_id - row_number() OVER (PARTITION BY group_id ORDER BY row_id) AS run FROM split_rows),
        steps AS (SELECT *, row_number() OVER (PARTITION BY group_id, run ORDER BY row_id) - 16 AS after FROM runs)
        SELECT split, code, count(*) AS n_windows, count(DISTINCT group_id) AS n_groups, sum(row_id - 15)::BIGINT AS first_rows, sum(round((value - v0) / (v1 - v0), 6)::DECIMAL(18, 6))::DOUBLE AS last_values
        FROM steps JOIN codes USING (label), bounds WHERE after >= 0 AND after % 8 = 0 GROUP BY 1, 2""",
}
