"""The registered queries in SQL, for a check against another engine."""

from __future__ import annotations

CLASS = "CASE WHEN (user_id // 2) % 10 = 0 THEN 2 WHEN (user_id // 2) % 10 < 4 THEN 1 ELSE 0 END"
K = r"try_cast(regexp_extract(props, '(\d+)', 1) AS DOUBLE)"
VISITS = f"""visits AS (
  SELECT event_id, ts, user_id, value, {K} AS k, CAST({CLASS} AS INTEGER) AS label FROM events)"""
STEPPED = f"""{VISITS}, stepped AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS step,
         count(*) OVER (PARTITION BY user_id) AS visits_n FROM visits)"""
PACKED = f"{STEPPED}, packed AS (SELECT *, CAST(visits_n AS INTEGER) AS len FROM stepped)"
NUMERICS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def unit(key: str, seed: str = "42") -> str:
    return (f"(CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{seed}'), 1, 8) AS BIGINT)"
            f" / 4294967296.0::DOUBLE)")


def scaled(shift: str, width: str, where: str = "TRUE") -> str:
    columns = ", ".join(f"round((l.{c} - s.{c}_m) / s.{c}_w, 6) AS {c}" for c in NUMERICS)
    stats = ", ".join(f"{shift.format(c)} AS {c}_m, {width.format(c)} AS {c}_w" for c in NUMERICS)
    return (f"WITH s AS (SELECT {stats} FROM lineitem) "
            f"SELECT l_orderkey, l_linenumber, {columns} FROM lineitem l, s")


def profile(name: str, label: str) -> str:
    return f"""
      SELECT {label}, n, round(n / sum(n) OVER ()::DOUBLE, 9) AS share,
             round(n / max(n) OVER ()::DOUBLE, 9) AS ratio
      FROM (SELECT {label}, count(*) AS n FROM {name} GROUP BY 1)"""


def plan(share: str, lam: float, label: str, source: str, n: str) -> str:
    """Targets by largest remainder. ``source`` gives ``label, share``."""
    return f"""
      w AS (SELECT {label}, round(({n})::DOUBLE * ((1.0 - {lam})::DOUBLE * {share} + {lam}::DOUBLE / count(*) OVER ()), 6) AS want
            FROM {source}),
      f AS (SELECT {label}, want, floor(want) AS fl, ({n}) - sum(floor(want)) OVER () AS rest FROM w),
      plan AS (SELECT {label}, CAST(fl + CASE WHEN row_number() OVER (ORDER BY want - fl DESC, {label}) <= rest
                                         THEN 1 ELSE 0 END AS BIGINT) AS target FROM f)"""


def quality_plan(lam: float) -> str:
    return f"""WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1),
      s AS (SELECT quality, n / sum(n) OVER ()::DOUBLE AS share FROM c),
      {plan('share', lam, 'quality', 's', '15904')}
      SELECT quality, target FROM plan"""


def ks(values: str, by: str = "") -> str:
    """``values`` gives ``by, feature, a (1 real, 0 synthetic), value``."""
    g = f"{by}, feature" if by else "feature"
    p = f"PARTITION BY {g}"
    terms = " + ".join(f"{2.0 * (-1) ** (j - 1)}::DOUBLE * exp(-{2 * j * j}::DOUBLE * lam * lam)" for j in range(1, 9))
    over = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    return f"""WITH v AS ({values}),
      t AS (SELECT {g}, count(value) FILTER (a = 1) AS n1, count(value) FILTER (a = 0) AS n0,
                   count(*) FILTER (value IS NULL) AS nulls FROM v GROUP BY ALL),
      c AS (SELECT {g}, value, count(*) FILTER (a = 1) AS c1, count(*) FILTER (a = 0) AS c0
            FROM v WHERE value IS NOT NULL GROUP BY ALL),
      r AS (SELECT {g}, sum(c1) OVER ({p} ORDER BY value) AS r1, sum(c0) OVER ({p} ORDER BY value) AS r0 FROM c),
      d AS (SELECT {g}, n1, n0, nulls, max(abs(r1::DOUBLE / n1 - r0::DOUBLE / n0)) AS d
            FROM r JOIN t USING ({g}) GROUP BY ALL),
      l AS (SELECT *, n1::DOUBLE * n0 / (n1 + n0) AS m FROM d),
      q AS (SELECT *, (sqrt(m) + 0.12::DOUBLE + 0.11::DOUBLE / sqrt(m)) * d AS lam FROM l),
      z AS (SELECT *, CASE WHEN lam < 0.3::DOUBLE THEN 1.0::DOUBLE
                           ELSE greatest(least({terms}, 1.0::DOUBLE), 0.0::DOUBLE) END AS p FROM q)
      SELECT {g}, n1, n0, nulls, round(d, 9) AS d, round(p, 9) AS p_value, p > 0.05 AS passed,
             round(avg(CASE WHEN p > 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) {over}, 9) AS share_passed
      FROM z"""


def split_side(width: int = 64) -> str:
    """Exact 70/30 sides of the embeddings, with the leading dimensions in long form."""
    return f"""ranked AS (
        SELECT vec_id, label, embedding,
               row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || '|42')) AS r,
               count(*) OVER (PARTITION BY label) AS n FROM embeddings),
      sided AS (SELECT vec_id, label, embedding,
                CASE WHEN r <= floor(0.7::DOUBLE * n) THEN 'train' ELSE 'test' END AS side FROM ranked),
      dims AS (SELECT vec_id, label, side, unnest(range(1, {width + 1})) AS j,
                      unnest(embedding[1:{width}])::DOUBLE AS x FROM sided)"""


CENTROID = """means AS (SELECT label AS c, j, avg(x) AS m FROM dims WHERE side = 'train' GROUP BY 1, 2),
      gap AS (SELECT vec_id, label, c, sum((x - m) * (x - m)) AS d2
              FROM dims JOIN means USING (j) WHERE side = 'test' GROUP BY 1, 2, 3),
      pred AS (SELECT vec_id, label, c AS prediction FROM gap
               QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, c) = 1),
      cells AS (SELECT label, prediction, count(*) AS n FROM pred GROUP BY 1, 2)"""

METRICS = """sides AS (SELECT label AS c, n AS actual, 0 AS said,
                         CASE WHEN label = prediction THEN n ELSE 0 END AS hit FROM cells
                       UNION ALL SELECT prediction, 0, n, 0 FROM cells),
      per AS (SELECT c, sum(actual)::DOUBLE AS actual, sum(said)::DOUBLE AS said, sum(hit)::DOUBLE AS hit
              FROM sides GROUP BY 1),
      rates AS (SELECT c, actual, hit,
                CASE WHEN said > 0 THEN hit / said ELSE 0.0::DOUBLE END AS precision_,
                CASE WHEN actual > 0 THEN hit / actual ELSE 0.0::DOUBLE END AS recall_,
                CASE WHEN said + actual > 0 THEN 2 * hit / (said + actual) ELSE 0.0::DOUBLE END AS f1_ FROM per),
      overall AS (SELECT sum(hit) / sum(actual) AS accuracy,
                  avg(recall_) FILTER (actual > 0) AS balanced_accuracy,
                  avg(f1_) FILTER (actual > 0) AS macro_f1 FROM rates)"""


def overall(width: int) -> str:
    return f"""(WITH {split_side(width)}, {CENTROID}, {METRICS}
        SELECT 'accuracy' AS metric, accuracy AS value FROM overall
        UNION ALL SELECT 'balanced_accuracy', balanced_accuracy FROM overall
        UNION ALL SELECT 'macro_f1', macro_f1 FROM overall)"""


def mix(points: str, k: int = 5) -> str:
    """All pairs; rows tied at the k-th distance count in equal parts."""
    return f"""WITH pts AS ({points}),
      pairs AS (SELECT q.id, q.source, s.source AS other,
                       round(sqrt(list_sum(list_transform(list_zip(q.x, s.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9) AS d
                FROM pts q JOIN pts s ON q.id <> s.id),
      byd AS (SELECT id, source, d, count(*) AS everyone, count(*) FILTER (other = source) AS same
              FROM pairs GROUP BY ALL),
      run AS (SELECT *, coalesce(sum(everyone) OVER (PARTITION BY id ORDER BY d
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM byd),
      used AS (SELECT *, least(everyone, {k} - before)::DOUBLE AS used FROM run WHERE before < {k}),
      shares AS (SELECT id, source, sum(same * used / everyone) / sum(used) AS share FROM used GROUP BY ALL),
      sizes AS (SELECT source, count(*) AS m, (SELECT count(*) FROM pts) AS total FROM pts GROUP BY 1)
      SELECT source, count(*) AS n, round(avg(share), 6) AS same_share,
             round(any_value((m - 1)::DOUBLE / (total - 1)), 6) AS expected_share
      FROM shares JOIN sizes USING (source) GROUP BY source"""


def collapsed_mix(k: int = 5) -> str:
    """As ``mix`` on two coordinates, with copies counted first: only points as near as the k-th other
    one are kept."""
    return f"""WITH {VISITS},
      pts AS (SELECT row_number() OVER (ORDER BY value, k) AS id, value AS x, k AS y, count(*) FILTER (user_id % 2 = 0) AS n1,
                     count(*) FILTER (user_id % 2 = 1) AS n0 FROM visits WHERE value IS NOT NULL AND k IS NOT NULL GROUP BY value, k),
      edge AS (SELECT p.id, list_max(min((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y), {k})) + 0.000001::DOUBLE AS e
               FROM pts p JOIN pts q ON p.id <> q.id GROUP BY 1),
      near AS (SELECT p.id, p.n1 AS own1, p.n0 AS own0, round(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)), 9) AS d, q.n1, q.n0
               FROM pts p JOIN edge USING (id) JOIN pts q ON (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= e),
      byd AS (SELECT id, own1, own0, d, sum(n1) AS n1, sum(n0) AS n0 FROM near GROUP BY ALL),
      own AS (SELECT id, d, s.source, CASE s.source WHEN 'real' THEN own1 ELSE own0 END AS rows_, n1 + n0 - CASE WHEN d = 0 THEN 1 ELSE 0 END AS everyone,
                     CASE s.source WHEN 'real' THEN n1 ELSE n0 END - CASE WHEN d = 0 THEN 1 ELSE 0 END AS same
              FROM byd, (VALUES ('real'), ('synth')) AS s(source)),
      run AS (SELECT *, coalesce(sum(everyone) OVER (PARTITION BY id, source ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
              FROM own WHERE rows_ > 0),
      used AS (SELECT *, least(everyone, {k} - before)::DOUBLE AS used FROM run WHERE before < {k} AND everyone > 0),
      shares AS (SELECT id, source, rows_, sum(same * used / everyone) / sum(used) AS share FROM used GROUP BY ALL),
      total AS (SELECT sum(n1) AS t1, sum(n0) AS t0 FROM pts)
      SELECT source, CAST(sum(rows_) AS BIGINT) AS n, round(sum(share * rows_) / sum(rows_), 6) AS same_share,
             round(any_value((CASE source WHEN 'real' THEN t1 ELSE t0 END - 1)::DOUBLE / (t1 + t0 - 1)), 6) AS expected_share
      FROM shares, total GROUP BY source"""


def _sequence_features() -> str:
    """Flat visits, differences, slopes, lag products, by position."""
    return f"""WITH {PACKED},
      f AS (SELECT user_id, step - 1 AS t, len, 0 AS j, value AS x FROM packed
            UNION ALL SELECT user_id, step - 1, len, 1, k FROM packed),
      users AS (SELECT DISTINCT user_id FROM packed),
      m AS (SELECT max(len) AS m FROM packed),
      grid AS (SELECT user_id, t, j FROM users, range((SELECT m FROM m)) AS a(t), range(2) AS b(j)),
      lagged AS (SELECT *, lag(x) OVER (PARTITION BY user_id, j ORDER BY t) AS px FROM f),
      full_ AS (SELECT g.user_id, g.t, g.j, l.x, l.px FROM grid g LEFT JOIN lagged l USING (user_id, t, j)),
      agg AS (SELECT user_id, j, any_value(len) AS len,
                     sum((t - (len - 1) / 2.0::DOUBLE) * x) AS top, avg(x * px) AS lp FROM lagged GROUP BY 1, 2)
      SELECT user_id, CAST(t * 2 + j AS INTEGER) AS pos, round(coalesce(x, 0), 5) AS value FROM full_
      UNION ALL SELECT user_id, CAST(2 * (SELECT m FROM m) + (t - 1) * 2 + j AS INTEGER), round(coalesce(x - px, 0), 5)
                FROM full_ WHERE t > 0
      UNION ALL SELECT user_id, CAST(4 * (SELECT m FROM m) - 2 + j AS INTEGER),
                round(CASE WHEN len > 1 THEN top / (len * (len * len - 1.0::DOUBLE) / 12) ELSE 0 END, 5) FROM agg
      UNION ALL SELECT user_id, CAST(4 * (SELECT m FROM m) + j AS INTEGER), round(coalesce(lp, 0), 5) FROM agg"""


def _order_features() -> str:
    """Mean, last visit, mean step, iterated sums and products of steps, by position."""
    now, was, d = ("value", "k"), ("pv", "pk"), ("value - pv", "k - pk")
    columns = [f"avg({x})" for x in now] + [f"max_by({x}, step)" for x in now] + [f"(max_by({x}, step) - min_by({x}, step)) / s" for x in now]
    columns += [f"(coalesce(sum({was[i]} * ({d[j]})), 0) - min_by({now[i]}, step) * (max_by({now[j]}, step) - min_by({now[j]}, step))) / s"
                for i in range(2) for j in range(2)]
    columns += [f"coalesce(sum(({d[i]}) * ({d[j]})), 0) / s" for i, j in ((0, 0), (0, 1), (1, 1))]
    steps = "greatest(count(*) - 1, 1)"
    listed = ", ".join(f"({c.replace('/ s', f'/ {steps}')}) * count(*) * {steps}" for c in columns)
    return f"""WITH {STEPPED},
      l AS (SELECT user_id, step, value, k, lag(value) OVER w AS pv, lag(k) OVER w AS pk FROM stepped
            WINDOW w AS (PARTITION BY user_id ORDER BY step)),
      f AS (SELECT user_id, [{listed}]::DOUBLE[] AS f FROM l GROUP BY 1)
      SELECT user_id, CAST(unnest(range(len(f))) AS INTEGER) AS pos, round(unnest(f), 5) AS value FROM f"""


GAPPY = "CASE WHEN event_type <> 'error' THEN value END"

ORDERED = """o AS (SELECT o_custkey, o_orderkey, c_mktsegment, quantity, n_lines, o_totalprice::DOUBLE AS o_totalprice,
             row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS visit
      FROM orders JOIN (SELECT l_orderkey, sum(l_quantity)::DOUBLE AS quantity, count(*)::DOUBLE AS n_lines FROM lineitem GROUP BY 1)
        ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey)"""
ORDER_FEATURES = ("quantity", "n_lines", "o_totalprice")


def draws(source: str, entity: str, label: str) -> str:
    """Class and length by hash of the id, two ids for each entity of ``source``."""
    return f"""
        u AS (SELECT {entity}, min({label}) AS label, count(*) AS len FROM {source} GROUP BY 1),
        c AS (SELECT label, count(*) AS n FROM u GROUP BY 1),
        cc AS (SELECT label, sum(n / (SELECT sum(n) FROM c)::DOUBLE) OVER (ORDER BY label) AS upto FROM c),
        l AS (SELECT label, len, count(*) AS n FROM u GROUP BY 1, 2),
        ll AS (SELECT label, len, sum(n) OVER (PARTITION BY label ORDER BY len)
                      / sum(n) OVER (PARTITION BY label)::DOUBLE AS upto FROM l),
        ids AS (SELECT range AS entity_id, {unit("range", "42|class")} AS uc,
                       {unit("range", "42|len")} AS ul FROM range(2 * (SELECT count(*) FROM u))),
        drawn AS (SELECT entity_id, ul, min(cc.label) FILTER (cc.upto > uc) AS label FROM ids, cc GROUP BY 1, 2)
        SELECT d.entity_id, d.label, CAST(min(ll.len) FILTER (ll.upto > d.ul) AS INTEGER) AS len
        FROM drawn d JOIN ll ON ll.label = d.label GROUP BY 1, 2"""


def softmax(rounds: int, rate: float, width: int = 8) -> str:
    """Full-gradient rounds from zero on standardised features; feature 0 is the bias."""
    steps = []
    for r in range(1, rounds + 1):
        steps.append(f"""s{r} AS (SELECT vec_id, label, c, sum(x * w) AS s FROM tr JOIN w{r - 1} USING (j) GROUP BY ALL),
      e{r} AS (SELECT vec_id, label, c, exp(s - max(s) OVER (PARTITION BY vec_id)) AS e FROM s{r}),
      g{r} AS (SELECT vec_id, c, e / sum(e) OVER (PARTITION BY vec_id) - CASE WHEN label = c THEN 1 ELSE 0 END AS g FROM e{r}),
      w{r} AS (SELECT w{r - 1}.c, w{r - 1}.j, any_value(w) - {rate}::DOUBLE * avg(g * x) AS w FROM w{r - 1} JOIN tr USING (j)
               JOIN g{r} ON g{r}.vec_id = tr.vec_id AND g{r}.c = w{r - 1}.c GROUP BY 1, 2)""")
    return f"""{split_side(width)}, st AS (SELECT j, avg(x) AS m, stddev_samp(x) AS d FROM dims WHERE side = 'train' GROUP BY 1),
      z AS (SELECT vec_id, label, side, j, (x - m) / d AS x FROM dims JOIN st USING (j)
            UNION ALL SELECT vec_id, label, side, 0, 1 FROM sided),
      tr AS (SELECT * FROM z WHERE side = 'train'),
      w0 AS (SELECT c, j, 0::DOUBLE AS w FROM range(10) AS a(c), range({width + 1}) AS b(j)),
      {", ".join(steps)}"""


def two_axes(where: str = "TRUE") -> str:
    """Standardising step and correlation of two features. The axes of a 2 x 2 correlation matrix are
    (1, 1) and (1, -1) over the root of two, with shares (1 + r) / 2 and (1 - r) / 2."""
    return f"""s AS (SELECT avg(l_quantity) AS ma, stddev_samp(l_quantity) AS wa, avg(l_extendedprice) AS mb,
                    stddev_samp(l_extendedprice) AS wb, corr(l_quantity, l_extendedprice) AS r FROM lineitem WHERE {where}),
      z AS (SELECT l_orderkey, l_linenumber, l_linestatus, (l_quantity - ma) / wa AS a, (l_extendedprice - mb) / wb AS b, r FROM lineitem, s),
      p AS (SELECT *, (a + sign(r) * b) / sqrt(2::DOUBLE) AS c1, (a - sign(r) * b) / sqrt(2::DOUBLE) AS c2 FROM z)"""


ORACLE = {
    "staged_m1": f"""WITH raw AS (SELECT user_id, ts, event_id, {GAPPY} AS value, {K} AS k, {CLASS} AS label, {unit("user_id")} < 0.7::DOUBLE AS train FROM events),
        med AS (SELECT median(value) AS mv, median(k) AS mk FROM raw WHERE train),
        full_ AS (SELECT user_id, ts, event_id, train, coalesce(value, mv) AS value, coalesce(k, mk) AS k,
                         CASE label WHEN 0 THEN 'common' WHEN 1 THEN 'seldom' ELSE 'rare' END AS kind FROM raw, med),
        names AS (SELECT kind, CAST(row_number() OVER (ORDER BY kind) - 1 AS INTEGER) AS label FROM (SELECT DISTINCT kind FROM full_ WHERE train)),
        st AS (SELECT avg(value) AS av, stddev_samp(value) AS dv, avg(k) AS ak, stddev_samp(k) AS dk FROM full_ JOIN names USING (kind) WHERE train),
        last AS (SELECT user_id, label, train, (value - av) / dv AS v, (k - ak) / dk AS w FROM full_ JOIN names USING (kind), st
                 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
        means AS (SELECT label AS c, avg(v) AS mv, avg(w) AS mw FROM last WHERE train GROUP BY 1),
        pred AS (SELECT user_id, label, c AS prediction FROM last, means WHERE NOT train
                 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (v - mv) * (v - mv) + (w - mw) * (w - mw), c) = 1),
        cells AS (SELECT label, prediction, count(*) AS n FROM pred GROUP BY 1, 2), {METRICS},
        said AS (SELECT 'precision' AS metric, c AS label, precision_ AS value FROM rates UNION ALL SELECT 'recall', c, recall_ FROM rates
                 UNION ALL SELECT 'f1', c, f1_ FROM rates UNION ALL SELECT 'accuracy', NULL, accuracy FROM overall
                 UNION ALL SELECT 'balanced_accuracy', NULL, balanced_accuracy FROM overall UNION ALL SELECT 'macro_f1', NULL, macro_f1 FROM overall)
        SELECT 'M1' AS model, 'real' AS train_source, metric, label, round(value, 9) AS value FROM said""",
    "csv_bad_rows": """SELECT 'value' AS "column", 'bad_value' AS kind, count(*) AS n FROM events WHERE event_id % 50 = 0
        UNION ALL SELECT 'day', 'missing', count(*) FROM events WHERE event_id % 50 = 1
        UNION ALL SELECT '*', 'field_count', count(*) FROM events WHERE event_id % 70 = 2""",
    "csv_good_rows": """SELECT event_id, user_id, round(value, 6) AS value, strftime(ts, '%Y-%m-%d') AS day FROM events
        WHERE event_id % 50 > 1 AND event_id % 70 <> 2""",
    "label_index_many": """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey END AS name FROM orders)
        SELECT o_orderkey, name, CASE WHEN name IS NOT NULL THEN CAST(dense_rank() OVER (ORDER BY name NULLS LAST) - 1 AS INTEGER) END AS label
        FROM r""",
    "plan_many": f"""WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
        s AS (SELECT o_custkey, n / sum(n) OVER ()::DOUBLE AS share FROM c),
        {plan('share', 0.9, 'o_custkey', 's', '10 * (SELECT count(*) FROM c)')} SELECT o_custkey, target FROM plan""",
    "ks_phases": " UNION ALL ".join(f"""SELECT phase, {label}, '{level}' AS level, feature, n1, n0, nulls, d, p_value, passed FROM ({ks(f'''
        SELECT p.phase, event_type AS label, 'value' AS feature, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS a, value
        FROM events JOIN (VALUES ('phase1'), ('phase2')) AS p(phase)
          ON user_id % 2 = 0 OR (p.phase = 'phase1') = (event_id % 3 = 0)''', by)})""" for label, level, by in (
            ("label", "class", "phase, label"), ("NULL AS label", "phase", "phase"))),
    "pca_two_axes": f"""WITH {two_axes()}
        SELECT CAST(c AS INTEGER) AS component, f AS feature,
               round(CASE WHEN f = 'l_quantity' THEN 1 WHEN c = 1 THEN sign(r) ELSE -sign(r) END / sqrt(2::DOUBLE), 9) AS weight,
               round((CASE WHEN c = 1 THEN 1 + abs(r) ELSE 1 - abs(r) END) / 2, 9) AS share,
               round(CASE WHEN c = 1 THEN (1 + abs(r)) / 2 ELSE 1 END, 9) AS running_share
        FROM s, range(1, 3) AS t(c), (VALUES ('l_quantity'), ('l_extendedprice')) AS n(f)""",
    "pca_two_scores": f"WITH {two_axes()} SELECT l_orderkey, l_linenumber, round(c1, 6) AS pc1, round(c2, 6) AS pc2 FROM p",
    "pca_two_inverse": f"""WITH {two_axes()} SELECT l_orderkey, l_linenumber, round(c1 / sqrt(2::DOUBLE) * wa + ma, 4) AS l_quantity,
        round(sign(p.r) * c1 / sqrt(2::DOUBLE) * wb + mb, 4) AS l_extendedprice FROM p, s""",
    "project_pair_lines": f"""WITH {two_axes("l_linestatus = 'F'")} SELECT l_orderkey, l_linenumber,
        CASE WHEN l_linestatus = 'F' THEN 'real' ELSE 'synth' END AS source, round(c1, 6) AS pc1, round(c2, 6) AS pc2 FROM p""",
    "projection_overlap_lines": f"""WITH {two_axes("l_linestatus = 'F'")},
        c AS (SELECT floor(c1 / 0.37::DOUBLE) AS cx, floor(c2 / 0.37::DOUBLE) AS cy, count(*) FILTER (l_linestatus = 'F') AS n1,
              count(*) FILTER (l_linestatus <> 'F') AS n0 FROM p GROUP BY 1, 2)
        SELECT round(sum(least(n1::DOUBLE / (SELECT sum(n1) FROM c), n0::DOUBLE / (SELECT sum(n0) FROM c))), 9) AS overlap,
            count(*) AS cells, count(*) FILTER (n1 > 0 AND n0 > 0) AS shared_cells, 0 AS nulls FROM c""",
    "median_impute": f"""WITH g AS (SELECT event_id, user_id, {GAPPY} AS value, CASE WHEN event_type <> 'view' THEN {K} END AS k FROM events),
        m AS (SELECT median(value) AS mv, median(k) AS mk FROM g WHERE {unit("user_id")} < 0.7::DOUBLE)
        SELECT event_id, round(coalesce(value, mv), 6) AS value, round(coalesce(k, mk), 6) AS k FROM g, m""",

    "orders_pack": f"WITH {ORDERED} SELECT o_custkey, c_mktsegment, visit, quantity, n_lines, o_totalprice FROM o",
    "orders_lags": f"WITH {ORDERED} SELECT o_orderkey, visit AS step, " + ", ".join(
        f"round({f} - lag({f}) OVER (PARTITION BY o_custkey ORDER BY visit), 4) AS d_{f}" for f in ORDER_FEATURES) + " FROM o",
    "orders_draws": f"WITH {ORDERED}, {draws('o', 'o_custkey', 'c_mktsegment')}",
    "split_null_class": """WITH k AS (SELECT event_id, nullif(event_type, 'error') AS kind FROM events),
        r AS (SELECT event_id, kind, count(*) OVER (PARTITION BY kind) AS n,
              row_number() OVER (PARTITION BY kind ORDER BY md5(CAST(event_id AS VARCHAR) || '|42')) AS r FROM k)
        SELECT kind, CASE WHEN r <= floor(0.7::DOUBLE * n) THEN 'train' ELSE 'test' END AS side, count(*) AS n,
               CAST(sum(event_id) AS BIGINT) AS ids FROM r GROUP BY 1, 2""",
    "csv_roundtrip": """SELECT event_id, epoch_us(ts) AS ts_us, user_id,
        CASE user_id % 3 WHEN 0 THEN '' WHEN 1 THEN props END AS props, value, CAST(user_id % 4 AS INTEGER) AS label FROM events""",
    "records_read": "SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS ts_us FROM events",
    "phase_roundtrip": """SELECT vec_id, label, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos, round(unnest(embedding)::DOUBLE, 6) AS x,
        CASE WHEN vec_id % 2 = 0 THEN 'phase1' ELSE 'phase2' END AS phase FROM embeddings""",
    "numeric_select": f"SELECT event_id, value, {K} AS k FROM events",
    "numeric_failures": f"""
        SELECT 'value' AS feature, count(*) AS n_rows, count(*) FILTER (value IS NULL) AS n_null,
               0::BIGINT AS n_failed FROM events
        UNION ALL SELECT 'k', count(*), 0::BIGINT, count(*) FILTER ({K} IS NULL) FROM events
        UNION ALL SELECT 'props', count(*), count(*) FILTER (props IS NULL),
               count(*) FILTER (props IS NOT NULL AND try_cast(props AS DOUBLE) IS NULL) FROM events
        UNION ALL SELECT 'event_type', count(*), count(*) FILTER (event_type IS NULL),
               count(*) FILTER (event_type IS NOT NULL AND try_cast(event_type AS DOUBLE) IS NULL) FROM events""",
    "visit_order": """SELECT event_id, user_id,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS step FROM events""",
    "locf_impute": f"""SELECT event_id, user_id, last_value({GAPPY} IGNORE NULLS) OVER (
        PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
        FROM events""",
    "mean_impute": f"""SELECT event_id, round(coalesce({GAPPY},
        (SELECT avg({GAPPY}) FROM events WHERE {unit("user_id")} < 0.7::DOUBLE)), 6) AS value FROM events""",
    "label_index": """SELECT c_custkey, c_mktsegment,
        CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS label FROM customer""",
    "class_profile_events": profile("events", "event_type"),
    "class_profile_labels": profile("labels", "quality"),
    "zscore": scaled("avg({})", "stddev_samp({})"),
    "minmax": scaled("min({})", "(max({0}) - min({0}))"),
    "unscale_roundtrip": "SELECT l_orderkey, l_linenumber, "
                         + ", ".join(f"round({c}, 4) AS {c}" for c in NUMERICS) + " FROM lineitem",
    "covariance_pairs": """WITH d AS (SELECT vec_id, unnest(range(len(embedding))) AS i,
            unnest(embedding)::DOUBLE AS x FROM embeddings)
        SELECT CAST(a.i AS INTEGER) AS feature_i, CAST(b.i AS INTEGER) AS feature_j, count(*) AS n,
               round(covar_samp(a.x, b.x), 6) AS cov
        FROM d a JOIN d b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY 1, 2""",
    "covariance_by_status": " UNION ALL ".join(
        f"""SELECT l_linestatus, '{a}' AS feature_i, '{b}' AS feature_j, count(*) AS n,
            round(covar_samp({a}, {b}), 3) AS cov FROM lineitem GROUP BY 1"""
        for i, a in enumerate(NUMERICS) for b in NUMERICS[i:]),
    "pca_roundtrip_error": """SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos,
        round(unnest(embedding)::DOUBLE, 5) AS value FROM embeddings""",
    "pca_total_variance": """WITH d AS (SELECT unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
        s AS (SELECT i, avg(x) AS m FROM d GROUP BY 1), v AS (SELECT i, var_samp(x) AS v, avg(x - m) AS c FROM d JOIN s USING (i) GROUP BY 1)
        SELECT round(sum(v), 6) AS total, round(max(abs(c)), 6) AS centre FROM v""",
    "pca_row_norms": """WITH d AS (SELECT vec_id, unnest(range(len(embedding))) AS i,
            unnest(embedding)::DOUBLE AS x FROM embeddings),
        s AS (SELECT i, avg(x) AS m, stddev_samp(x) AS w FROM d GROUP BY 1)
        SELECT vec_id, round(sum(((x - m) / w) * ((x - m) / w)), 5) AS norm2 FROM d JOIN s USING (i) GROUP BY 1""",
    "pack_events": f"""WITH {PACKED},
        users AS (SELECT user_id, any_value(label) AS label, any_value(len) AS len FROM packed GROUP BY 1)
        SELECT u.user_id, u.label, u.len, CAST(g.pos AS INTEGER) AS pos, p.step IS NOT NULL AS mask,
               coalesce(p.value, 0) AS value, coalesce(p.k, 0) AS k
        FROM users u CROSS JOIN range((SELECT max(len) FROM packed)) AS g(pos)
        LEFT JOIN packed p ON p.user_id = u.user_id AND p.step = g.pos + 1""",
    "unpack_events": f"WITH {PACKED} SELECT user_id, label, step, value, k FROM packed",
    "split_rows_70_30": f"WITH {split_side()} SELECT vec_id, label, side FROM sided",
    "split_rows_hash": f"""SELECT l_returnflag,
        CASE WHEN {unit("(l_orderkey || '|' || l_linenumber)")} < 0.7::DOUBLE THEN 'train' ELSE 'test' END AS side,
        count(*) AS n FROM lineitem GROUP BY 1, 2""",
    "split_entities_70_30": f"""SELECT event_id, user_id,
        CASE WHEN {unit("user_id")} < 0.7::DOUBLE THEN 'train' ELSE 'test' END AS side FROM events""",
    "static_last_visit": f"WITH {PACKED} SELECT user_id, label, value, k FROM packed WHERE step = len",
    "sequence_features": _sequence_features(),
    "order_features": _order_features(),
    "visit_differences": f"""WITH {STEPPED}
        SELECT event_id, step, round(value - lag(value) OVER w, 6) AS d_value, round(k - lag(k) OVER w, 6) AS d_k
        FROM stepped WINDOW w AS (PARTITION BY user_id ORDER BY step)""",
    "plan_proportional": quality_plan(0.0),
    "plan_near_balanced": quality_plan(0.9),
    "var1_moments": f"""WITH {PACKED},
        pairs AS (SELECT label, lag(value) OVER w AS x0, lag(k) OVER w AS x1, value AS x2, k AS x3, step
                  FROM packed WINDOW w AS (PARTITION BY user_id ORDER BY step)),
        kept AS (SELECT * FROM pairs WHERE step > 1)"""
        + " UNION ALL ".join(
            f"""SELECT label, count(*) AS n, {i} AS i, {j} AS j, round(avg(x{i}), 6) AS mean_i,
                round(covar_samp(x{i}, x{j}), 5) AS cov FROM kept GROUP BY label"""
            for i in range(4) for j in range(4)),
    "var1_fit": f"""WITH {STEPPED},
        pairs AS (SELECT label, lag(value) OVER (PARTITION BY user_id ORDER BY step) AS x, value AS y, step FROM stepped),
        m AS (SELECT label, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS xx, var_pop(y) * count(*) AS yy,
                     covar_pop(x, y) * count(*) AS xy FROM pairs WHERE step > 1 GROUP BY 1),
        a AS (SELECT *, xy / (xx + 0.001::DOUBLE * xx) AS a FROM m)
        SELECT label, CAST(0 AS INTEGER) AS i, CAST(0 AS INTEGER) AS j, round(a, 6) AS transition, round(my - a * mx, 6) AS intercept,
               round((yy - 2 * a * xy + a * a * xx) / (n - 1), 6) AS noise_cov FROM a""",
    "synth_counts": f"""WITH u AS (SELECT DISTINCT user_id FROM events),
        c AS (SELECT CAST({CLASS} AS INTEGER) AS label, count(*) AS n FROM u GROUP BY 1),
        s AS (SELECT label, n / sum(n) OVER ()::DOUBLE AS share FROM c),
        {plan('share', 0.9, 'label', 's', '10 * (SELECT count(*) FROM u)')}
        SELECT label, target AS n, target AS ids FROM plan""",
    "synth_draws": f"""WITH {STEPPED},
        u AS (SELECT user_id, any_value(label) AS label, count(*) AS len FROM stepped GROUP BY 1),
        c AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY label) AS place FROM u GROUP BY 1),
        cc AS (SELECT label, place, sum(n / (SELECT sum(n) FROM c)::DOUBLE) OVER (ORDER BY label) AS upto FROM c),
        l AS (SELECT label, len, count(*) AS n FROM u GROUP BY 1, 2),
        ll AS (SELECT label, len, sum(n) OVER (PARTITION BY label ORDER BY len)
                      / sum(n) OVER (PARTITION BY label)::DOUBLE AS upto FROM l),
        ids AS (SELECT range AS entity_id, {unit("range", "42|class")} AS uc,
                       {unit("range", "42|len")} AS ul FROM range(2 * (SELECT count(*) FROM u))),
        drawn AS (SELECT entity_id, ul, min(cc.label) FILTER (cc.upto > uc) AS label FROM ids, cc GROUP BY 1, 2)
        SELECT d.entity_id, d.label, CAST(min(ll.len) FILTER (ll.upto > d.ul) AS INTEGER) AS len, TRUE AS padded
        FROM drawn d JOIN ll ON ll.label = d.label GROUP BY 1, 2""",
    "synth_range_check": f"""WITH {VISITS}, r AS (SELECT min(value) AS lo, max(value) AS hi FROM visits)
        SELECT count(*) FILTER (value IS NULL OR k IS NULL) AS nulls, count(*) FILTER (value < lo OR value > hi) AS outside FROM visits, r""",
    "decode_clip": f"""WITH {STEPPED},
        m AS (SELECT avg(value) AS mv, min(value) AS lv, max(value) AS hv, avg(k) AS mk, min(k) AS lk, max(k) AS hk FROM stepped)
        SELECT user_id, label, step, round(least(greatest(mv + 1.37::DOUBLE * (value - mv), lv), hv), 3) AS value,
               round(least(greatest(mk + 1.37::DOUBLE * (k - mk), lk), hk), 3) AS k FROM stepped, m""",
    "softmax_trtr": f"""WITH {softmax(8, 0.5)},
        o AS (SELECT vec_id, label, c, sum(x * w) AS s FROM z JOIN w8 USING (j) WHERE side = 'test' GROUP BY ALL)
        SELECT vec_id, label, CAST(c AS INTEGER) AS prediction FROM o QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, c) = 1""",
    "softmax_weights": f"""WITH {softmax(8, 0.5)}
        SELECT CAST(c AS INTEGER) AS unit, CAST(j - 1 AS INTEGER) AS input, round(w / d, 6) AS weight FROM w8 JOIN st USING (j)
        UNION ALL SELECT c, -1, round(any_value(b.w) - sum(a.w * m / d), 6)
                  FROM w8 a JOIN st USING (j) JOIN (SELECT c, w FROM w8 WHERE j = 0) b USING (c) GROUP BY c""",
    "reject_to_plan": """WITH r AS (SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type) AS n,
            row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR) || '|42')) AS r FROM events)
        SELECT event_id, event_type FROM r WHERE r <= CASE WHEN event_type = 'error' THEN n + 100
            WHEN event_type = 'view' THEN 0 ELSE floor(n * 0.3::DOUBLE) END""",
    "reject_report": """WITH c AS (SELECT event_type, count(*) AS candidates FROM events GROUP BY 1),
        t AS (SELECT *, CAST(CASE WHEN event_type = 'error' THEN candidates + 100
            WHEN event_type = 'view' THEN 0 ELSE floor(candidates * 0.3::DOUBLE) END AS BIGINT) AS target FROM c)
        SELECT event_type, candidates, least(candidates, target) AS accepted, target,
            candidates - least(candidates, target) AS rejected, greatest(target - candidates, 0) AS shortfall FROM t""",
    "ks_lineitem_status": ks(" UNION ALL ".join(
        f"SELECT '{c}' AS feature, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS a, {c} AS value FROM lineitem"
        for c in NUMERICS)),
    "ks_events_by_type": ks("""SELECT event_type, 'value' AS feature,
        CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS a, value FROM events""", "event_type"),
    "grid_overlap": f"""WITH {VISITS},
        c AS (SELECT floor(value / 10) AS cx, floor(k / 10) AS cy, count(*) FILTER (user_id % 2 = 0) AS c1,
              count(*) FILTER (user_id % 2 = 1) AS c0 FROM visits GROUP BY 1, 2)
        SELECT round(sum(least(c1::DOUBLE / (SELECT sum(c1) FROM c), c0::DOUBLE / (SELECT sum(c0) FROM c))), 9) AS overlap,
            count(*) AS cells, count(*) FILTER (c1 > 0 AND c0 > 0) AS shared_cells,
            0 AS nulls FROM c""",
    "neighbour_mix": mix("""SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN 'real' ELSE 'synth' END AS source,
        embedding::DOUBLE[] AS x FROM embeddings"""),
    "neighbour_mix_events": collapsed_mix(),
    "lag_fidelity": f"""WITH {STEPPED},
        f AS (SELECT user_id, label, step, 'value' AS feature, value AS x FROM stepped
              UNION ALL SELECT user_id, label, step, 'k', k FROM stepped),
        p AS ({" UNION ALL ".join(
            f'''SELECT user_id, label, feature, {g} AS lag, x,
                lag(x, {g}) OVER (PARTITION BY user_id, feature ORDER BY step) AS px FROM f''' for g in (1, 2, 3))})
        SELECT label, feature, CAST(lag AS INTEGER) AS lag,
            count(*) FILTER (user_id % 2 = 0 AND x IS NOT NULL AND px IS NOT NULL) AS n_real,
            count(*) FILTER (user_id % 2 = 1 AND x IS NOT NULL AND px IS NOT NULL) AS n_synth,
            round(corr(x, px) FILTER (user_id % 2 = 0), 6) AS r_real,
            round(corr(x, px) FILTER (user_id % 2 = 1), 6) AS r_synth,
            round(abs(corr(x, px) FILTER (user_id % 2 = 0) - corr(x, px) FILTER (user_id % 2 = 1)), 6) AS gap
        FROM p GROUP BY 1, 2, 3""",
    "moment_gap": "WITH v AS (" + " UNION ALL ".join(
        f"SELECT l_returnflag, l_linestatus = 'F' AS a, '{c}' AS feature, {c} AS x FROM lineitem" for c in NUMERICS)
        + """), g AS (SELECT l_returnflag, feature, avg(x) FILTER (a) AS m1, avg(x) FILTER (NOT a) AS m0,
            stddev_samp(x) FILTER (a) AS s1, stddev_samp(x) FILTER (NOT a) AS s0 FROM v GROUP BY 1, 2)
        SELECT l_returnflag, feature, round(m1, 6) AS mean_real, round(m0, 6) AS mean_synth, round(s1, 6) AS sd_real,
            round(s0, 6) AS sd_synth, round(m0 - m1, 6) AS mean_gap, round(s0 - s1, 6) AS sd_gap FROM g""",
    "quality_checks": f"""WITH v AS (SELECT user_id % 2 = 0 AS a, {GAPPY} AS value, {K} AS k FROM events),
        lim AS (SELECT min(value) AS lv, max(value) AS hv, min(k) AS lk, max(k) AS hk FROM v WHERE a),
        s AS (SELECT * FROM v WHERE NOT a),
        kinds AS (SELECT round(value, 6) AS value, round(k, 6) AS k, count(*) FILTER (a) AS r,
                  count(*) FILTER (NOT a) AS s FROM v GROUP BY 1, 2)
        SELECT 'nulls' AS "check", 'value' AS feature, (count(*) - count(value))::DOUBLE AS value FROM s
        UNION ALL SELECT 'nulls', 'k', (count(*) - count(k))::DOUBLE FROM s
        UNION ALL SELECT 'out_of_range_share', 'value',
            round(count(*) FILTER (value < lv OR value > hv)::DOUBLE / count(value), 9) FROM s, lim
        UNION ALL SELECT 'out_of_range_share', 'k',
            round(count(*) FILTER (k < lk OR k > hk)::DOUBLE / count(k), 9) FROM s, lim
        UNION ALL SELECT 'repeats', '*', sum(greatest(s - 1, 0))::DOUBLE FROM kinds
        UNION ALL SELECT 'copied_from_real', '*', sum(CASE WHEN r > 0 THEN s ELSE 0 END)::DOUBLE FROM kinds""",
    "centroid_confusion": f"WITH {split_side()}, {CENTROID} SELECT label, prediction, n FROM cells",
    "centroid_metrics": f"""WITH {split_side()}, {CENTROID}, {METRICS}
        SELECT 'precision' AS metric, c AS label, round(precision_, 9) AS value FROM rates
        UNION ALL SELECT 'recall', c, round(recall_, 9) FROM rates
        UNION ALL SELECT 'f1', c, round(f1_, 9) FROM rates
        UNION ALL SELECT 'accuracy', NULL, round(accuracy, 9) FROM overall
        UNION ALL SELECT 'balanced_accuracy', NULL, round(balanced_accuracy, 9) FROM overall
        UNION ALL SELECT 'macro_f1', NULL, round(macro_f1, 9) FROM overall""",
    "centroid_tstr": f"""WITH dims AS (SELECT vec_id, label,
            CASE WHEN vec_id % 2 = 1 THEN 'train' ELSE 'test' END AS side, unnest(range(64)) AS j,
            unnest(embedding)::DOUBLE AS x FROM embeddings), {CENTROID}
        SELECT label, prediction, n FROM cells""",
    "compare_models": f"""SELECT a.metric, round(a.value, 9) AS base_value, round(b.value, 9) AS other_value,
            round(b.value - a.value, 9) AS points, round((b.value - a.value) / nullif(a.value, 0), 9) AS relative
        FROM {overall(8)} a JOIN {overall(64)} b USING (metric)""",
}
