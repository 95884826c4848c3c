"""The forests of the M queries in DuckDB's SQL: one recursive query holds rows, open nodes, closed nodes and votes, told apart by a tag."""

from __future__ import annotations

from sealcheck.operators.forest import BINS, CANDIDATES, CLASSES, LEAST_LEAF, VOTE_UNIT, WEIGHT_UNIT, poisson_steps
from sealcheck.tables import FEATURES

N = range(len(CLASSES))


def each(text: str, join: str = ", ") -> str:
    return join.join(text.replace("#", str(i)) for i in N)


def forest(train: str, feature_sql: dict[str, str], trees: int, folds: bool, score: str | None = None, seed: int = 42) -> str:
    """CTEs up to ``grown``. ``train`` and ``score`` select sc.*, copy_no, label; rows of ``score`` are walked and never counted."""
    features = len(FEATURES)
    tries = -(-features // CANDIDATES)
    label = "list_position(['" + "', '".join(CLASSES) + "'], label) - 1"
    values = "[" + ", ".join(f"CAST({feature_sql[n]} AS DOUBLE)" for n in FEATURES) + "]"
    shares = "[" + ", ".join(f"{i}/{BINS}.0::DOUBLE" for i in range(1, BINS)) + "]"
    counted = f"SELECT capture, session_id, {label} AS label, max(copy_no) AS copies, any_value({values}) AS vals FROM ({train}) x GROUP BY capture, session_id, label"
    walked = f" UNION ALL SELECT 'scored|' || capture, session_id, {label}, 0, {values} FROM ({score}) x" if score else ""
    u = f"CAST('0x' || substr(md5(capture || '|' || session_id || '|' || k || '|' || tree || '|{seed}'), 1, 8) AS BIGINT)"
    poisson = " + ".join(f"CAST({u} >= {s} AS INT)" for s in poisson_steps())
    fold_source = "cls" if folds else "(SELECT '' AS fold, " + each("0::HUGEINT AS n#") + ")"
    weight = lambda i: f"CASE WHEN n{i} > 0 THEN CAST(floor({WEIGHT_UNIT} * (" + each("n#", " + ") + ") / ((" + each("CAST(n# > 0 AS INT)", " + ") + f") * n{i})) AS BIGINT) ELSE 0 END AS w{i}"
    side = lambda x: "(" + " + ".join(f"{x.format(i)} * {x.format(i)}" for i in N) + ") / (" + " + ".join(x.format(i) for i in N) + ")"
    left, right = "CAST(l{0} * w{0} AS DOUBLE)", "CAST((p{0} - l{0}) * w{0} AS DOUBLE)"
    child = lambda tail: f"substr(md5(node || '|' || {tail}), 1, 16)"
    empty = "NULL::INT[] AS bins, NULL::INT AS w, NULL::INT AS cnt"
    return f"""
pts AS MATERIALIZED (SELECT * FROM ({counted}{walked}) y),
cut AS MATERIALIZED (SELECT f, list_sort(list_distinct(quantile_cont(vals[f + 1], {shares}))) AS cuts FROM pts, range({features}) r(f) WHERE copies > 0 GROUP BY f),
cutlist AS (SELECT list(cuts ORDER BY f) AS c FROM cut),
pt AS MATERIALIZED (SELECT capture, session_id, label, copies, [CAST(len(list_filter(c[f + 1], lambda x: x < vals[f + 1])) AS INT) for f in range({features})] AS bins FROM pts, cutlist),
cls AS (SELECT capture AS fold, {each("sum(copies) FILTER (label = #) AS m#")} FROM pt WHERE copies > 0 GROUP BY capture),
cls0 AS (SELECT fold, {each("coalesce(m#, 0) AS n#")} FROM cls),
ftot AS (SELECT {each("sum(n#) AS t#")} FROM cls0),
held AS (SELECT fold, {each("t# - n# AS n#")} FROM {'cls0' if folds else fold_source} x, ftot),
wts AS MATERIALIZED (SELECT fold, {", ".join(weight(i) for i in N)} FROM held),
drawn AS (SELECT tree, capture, session_id, label, bins, copies, k, {poisson} AS d FROM pt, range({trees}) t(tree), range(1, 1 + greatest(1, copies)) r(k)),
first_rows AS MATERIALIZED (SELECT tree, capture, session_id, label, any_value(bins) AS bins, CAST(sum(CASE WHEN k <= copies THEN d ELSE 0 END) AS INT) AS w, CAST(count(*) FILTER (k <= copies AND d > 0) AS INT) AS cnt
  FROM drawn GROUP BY tree, capture, session_id, label),
grown(tag, depth, tree, node, fold, session_id, label, bins, w, cnt, salt, attempt, kind, n_rows, feature, bin, v0, v1, v2, v3) AS (
  SELECT 'row', 0, tree::INT, 'root', capture, session_id, label::INT, bins, w, cnt, NULL::VARCHAR, NULL::INT, NULL::VARCHAR, NULL::BIGINT, NULL::INT, NULL::INT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM first_rows
  UNION ALL SELECT 'open', 0, tree::INT, 'root', fold, NULL, NULL, NULL, NULL, NULL, 'root', 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM wts, range({trees}) t(tree)
  UNION ALL
  SELECT * FROM (
    WITH rws AS (SELECT tree, node, fold AS capture, session_id, label, bins, w, cnt FROM grown WHERE tag = 'row'),
    opn AS (SELECT depth, tree, node, fold, salt, attempt FROM grown WHERE tag = 'open'),
    cnd AS (SELECT tree, node, unnest(range({CANDIDATES})) AS place, unnest(list_slice(list_sort([md5(tree || '|' || salt || '|' || f) || lpad(CAST(f AS VARCHAR), 3, '0') for f in range({features})]),
        attempt * {CANDIDATES} + 1, (attempt + 1) * {CANDIDATES})) AS code FROM (SELECT DISTINCT tree, node, salt, attempt FROM opn) d),
    own AS (SELECT tree, node, place, CAST(substr(code, 33) AS INT) AS feature, bins[CAST(substr(code, 33) AS INT) + 1] AS bin, capture,
        {each("sum(CASE WHEN label = # THEN w ELSE 0 END) AS n#")}, sum(cnt) AS cnt FROM rws JOIN cnd USING (tree, node) WHERE w > 0 AND code IS NOT NULL GROUP BY ALL),
    ttl AS (SELECT tree, node, place, feature, bin, {each("sum(n#) AS t#")}, sum(cnt) AS tc FROM own GROUP BY ALL),
    lft AS (SELECT tree, node, fold, place, feature, bin, {each("t# - coalesce(n#, 0) AS n#")}, tc - coalesce(cnt, 0) AS cnt
      FROM ttl JOIN opn USING (tree, node) LEFT JOIN (SELECT * RENAME (capture AS fold) FROM own) o USING (tree, node, fold, place, feature, bin)),
    cum AS (SELECT tree, node, fold, place, feature, bin, {each("sum(n#) OVER up AS l#")}, sum(cnt) OVER up AS lc, {each("sum(n#) OVER every AS p#")}, sum(cnt) OVER every AS pc FROM lft WHERE cnt > 0
      WINDOW up AS (PARTITION BY tree, node, fold, place ORDER BY bin ROWS UNBOUNDED PRECEDING), every AS (PARTITION BY tree, node, fold, place)),
    rated AS (SELECT *, CASE WHEN lc >= {LEAST_LEAF} AND pc - lc >= {LEAST_LEAF} THEN {side(left)} + {side(right)} END AS score FROM cum JOIN wts USING (fold)),
    best AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY tree, node, fold ORDER BY score DESC NULLS LAST, place, bin) = 1),
    made AS (SELECT opn.depth, tree, node, fold, salt, attempt, feature, bin, pc, {each("coalesce(p# * w#, 0) AS q#")},
        CASE WHEN pc IS NULL OR ({each("CAST(p# > 0 AS INT)", " + ")}) <= 1 OR pc < {2 * LEAST_LEAF} THEN 'leaf' WHEN score IS NOT NULL THEN 'split' WHEN attempt + 1 < {tries} THEN 'retry' ELSE 'leaf' END AS kind
      FROM opn LEFT JOIN best USING (tree, node, fold)),
    done AS (SELECT depth, tree, node, fold, salt, attempt, kind, coalesce(pc, 0) AS n_rows, CASE WHEN kind = 'split' THEN feature END AS feature, CASE WHEN kind = 'split' THEN bin END AS bin,
        {each(f"CASE WHEN kind <> 'leaf' THEN NULL WHEN q0 + q1 + q2 + q3 > 0 THEN CAST(floor({VOTE_UNIT} * q# / (q0 + q1 + q2 + q3)) AS BIGINT) ELSE 0 END AS v#")},
        CASE kind WHEN 'split' THEN {child("feature || '|' || bin || '|l'")} WHEN 'retry' THEN {child("'retry'")} END AS ln, CASE WHEN kind = 'split' THEN {child("feature || '|' || bin || '|r'")} END AS rn FROM made),
    moves AS (SELECT DISTINCT tree, node, feature, bin, ln, rn FROM done WHERE kind <> 'leaf')
    SELECT 'out' AS tag, depth, tree, node, fold, NULL AS session_id, NULL::INT AS label, {empty}, salt, attempt, kind, n_rows, feature, bin, {each("v#")} FROM done
    UNION ALL SELECT 'vote', depth, tree, node, capture, session_id, label, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, {each("v#")}
      FROM done JOIN rws USING (tree, node) WHERE kind = 'leaf' AND {"capture = fold" if folds else "starts_with(capture, 'scored|')"}
    UNION ALL SELECT 'open', depth + 1, tree, child, fold, NULL, NULL, NULL, NULL, NULL, CASE WHEN kind = 'retry' THEN salt ELSE child END, CASE WHEN kind = 'retry' THEN attempt + 1 ELSE 0 END,
      NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT *, unnest(list_filter([ln, rn], lambda x: x IS NOT NULL)) AS child FROM done WHERE kind <> 'leaf') c
    UNION ALL SELECT 'row', 0, tree, CASE WHEN rn IS NULL OR bins[feature + 1] <= bin THEN ln ELSE rn END, capture, session_id, label, bins, w, cnt, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM rws JOIN moves USING (tree, node)
  ) step
)"""
