"""SQL text for DuckDB that states what each registered query must return."""

from __future__ import annotations

from checks.fixtures import SCALED_DIGITS, STOP_EPS, STOP_ROUNDS

SLOT_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"

IMP = f"""
imp AS (
  SELECT l_orderkey AS req,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {SLOT_ORDER}) AS INTEGER) AS seg,
    1 + CAST(l_quantity AS INTEGER) % 4 AS "show",
    least(1 + CAST(l_quantity AS INTEGER) % 4, CAST(round(l_discount * 100) AS INTEGER) % 3) AS click,
    4000000 + l_suppkey AS f1, 5000000 + p_size AS f2, 6000000 + ascii(l_returnflag) AS f3,
    1000000 + o_custkey AS c1, 2000000 + ascii(substr(o_orderpriority, 1, 1)) AS c2
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
)"""

LONG = (
    IMP
    + """,
long AS (SELECT req, seg, "show", click, unnest([f1, f2, f3, c1, c2]) AS fid FROM imp),
hist AS (SELECT fid, CAST(sum("show") AS BIGINT) AS n FROM long GROUP BY fid)"""
)

DICT = (
    LONG
    + """,
dict AS (
  SELECT fid, n, CAST(row_number() OVER (ORDER BY n DESC, fid) AS INTEGER) AS dim
  FROM hist WHERE n > 1000
)"""
)

FEAT = (
    DICT
    + """,
ex AS (
  SELECT req, seg, greatest(0, least(click, "show")) AS pos,
    "show" - greatest(0, least(click, "show")) AS neg FROM imp
),
feat AS (
  SELECT req, seg, dim FROM long JOIN dict USING (fid)
  UNION ALL SELECT req, seg, 0 FROM imp
),
wt AS (
  SELECT dim, 1e-2 * (dim % 7) - 2e-2 AS w, 2e-2 * (dim % 5) - 3e-2 AS mu
  FROM (SELECT dim FROM dict UNION ALL SELECT 0)
),
marg AS (
  SELECT req, seg, any_value(pos) AS pos, any_value(neg) AS neg, sum(w) AS z, sum(mu) AS xm
  FROM feat JOIN wt USING (dim) JOIN ex USING (req, seg) GROUP BY req, seg
)"""
)

DOC = """
doc AS (
  SELECT doc_id AS id, quality AS pos, 1 - quality AS neg,
    1 + 100 * ascii(substr(lang, 1, 1)) + ascii(substr(lang, 2, 1)) AS f1,
    20000 + CAST(substr(source, 4) AS INTEGER) AS f2,
    30000 + CAST(floor(ln(n_chars + 1)) AS INTEGER) AS f3
  FROM labels JOIN documents USING (doc_id)
),
dlong AS (SELECT id, pos, neg, unnest([f1, f2, f3]) AS fid FROM doc),
ddict AS (
  SELECT fid, CAST(row_number() OVER (ORDER BY fid) AS INTEGER) AS dim
  FROM (SELECT DISTINCT fid FROM dlong)
),
dfeat AS MATERIALIZED (
  SELECT id, pos, neg, dim FROM dlong JOIN ddict USING (fid)
  UNION ALL SELECT id, pos, neg, 0 FROM doc
),
dwt AS (
  SELECT dim, 1e-2 * (dim % 7) - 2e-2 AS w, 2e-2 * (dim % 5) - 3e-2 AS mu
  FROM (SELECT dim FROM ddict UNION ALL SELECT 0)
),
dmarg AS (
  SELECT id, any_value(pos) AS pos, any_value(neg) AS neg, round(sum(w), 9) AS z, sum(mu) AS xm
  FROM dfeat JOIN dwt USING (dim) GROUP BY id
)"""

SIGMOID = "CASE WHEN {z} >= 0 THEN 1 / (1 + exp(-({z}))) ELSE exp({z}) / (1 + exp({z})) END"


def sigma(z: str = "z") -> str:
    return "(" + SIGMOID.format(z=z) + ")"


def loss(z: str = "z") -> str:
    return f"(greatest(-({z}), 0.0) + ln(1 + exp(-abs({z}))))"


def counted_loss(z: str = "z") -> str:
    return f"(pos * {loss(z)} + neg * {loss(f'-({z})')})"


def rounded(value: str, digits: int) -> str:
    """Rounded, with minus zero turned into zero."""
    return f"CASE WHEN round({value}, {digits}) = 0 THEN 0.0 ELSE round({value}, {digits}) END"


def auc(margins: str, digits: int = 9) -> str:
    """Mid-rank area as a scalar query over `margins(pos, neg, z)`."""
    return f"""(
  SELECT CAST(sum(p * (below + q / 2e0)) AS DOUBLE) / (sum(p) * sum(q)) FROM (
    SELECT p, q, coalesce(sum(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
    FROM (SELECT round({sigma()}, {digits}) AS s, sum(pos) AS p, sum(neg) AS q FROM {margins} GROUP BY 1)))"""


def acc(margins: str) -> str:
    return (
        f"(SELECT CAST(sum(CASE WHEN z < 0 THEN neg ELSE pos END) AS DOUBLE) / sum(pos + neg)"
        f" FROM {margins})"
    )


CLICKS = (
    FEAT
    + """,
dfeat AS MATERIALIZED (
  SELECT struct_pack(r := req, s := seg) AS id, pos, neg, dim FROM feat JOIN ex USING (req, seg)
),
dwt AS (SELECT dim FROM wt)"""
)


def cg_rounds(
    plan: list[tuple[str, bool, str]], lam: str = "1e-1", examples: str = DOC
) -> str:
    """CTEs of conjugate gradient rounds 1.. over `examples`, which define dfeat and dwt.

    `plan` has one entry per round: row predicate, whether the direction starts afresh, and the
    weight table the penalty is centred on. Tables: w{k}, g{k}, m{k}, s{k} (scalars).
    """
    parts = ["w0 AS MATERIALIZED (SELECT dim, 0e0 AS v FROM dwt)"]
    for k, (rows, fresh, centre) in enumerate(plan, 1):
        p = k - 1
        parts.append(
            f"z{k} AS MATERIALIZED (SELECT id, any_value(pos) AS pos, any_value(neg) AS neg, sum(v) AS z"
            f" FROM dfeat JOIN w{p} USING (dim) WHERE {rows} GROUP BY id)"
        )
        parts.append(
            f"g{k} AS MATERIALIZED (SELECT w.dim, coalesce(d.g, 0) + {lam} * (w.v - c.v) AS g FROM w{p} w"
            f" JOIN {centre} c ON w.dim = c.dim LEFT JOIN (SELECT dim, sum(r) AS g FROM dfeat JOIN"
            f" (SELECT id, (pos + neg) * {sigma()} - pos AS r FROM z{k}) USING (id) GROUP BY dim) d"
            f" ON w.dim = d.dim)"
        )
        if fresh:
            parts.append(f"b{k} AS MATERIALIZED (SELECT 0e0 AS beta, 0e0 AS gtold)")
            parts.append(f"m{k} AS MATERIALIZED (SELECT dim, -g AS mu FROM g{k})")
        else:
            parts.append(
                f"b{k} AS MATERIALIZED (SELECT sum(n.g * n.g) / sum(m.mu * (n.g - o.g)) AS beta,"
                f" sum(o.g * m.mu) AS gtold FROM g{k} n JOIN g{p} o USING (dim) JOIN m{p} m USING (dim))"
            )
            parts.append(
                f"m{k} AS MATERIALIZED (SELECT m.dim, b.beta * m.mu - n.g AS mu"
                f" FROM m{p} m JOIN g{k} n USING (dim), b{k} b)"
            )
        parts.append(
            f"x{k} AS (SELECT id, sum(mu) AS xm FROM dfeat JOIN m{k} USING (dim) GROUP BY id)"
        )
        parts.append(
            f"s{k} AS MATERIALIZED (SELECT gtd, gg, uhu, -gtd / uhu AS alpha FROM"
            f" (SELECT sum(g * mu) AS gtd, sum(g * g) AS gg, sum(mu * mu) AS mm FROM g{k} JOIN m{k} USING (dim)),"
            f" LATERAL (SELECT (SELECT sum((pos + neg) * {sigma()} * (1 - {sigma()}) * xm * xm)"
            f" FROM z{k} JOIN x{k} USING (id)) + {lam} * mm AS uhu))"
        )
        parts.append(
            f"w{k} AS MATERIALIZED (SELECT w.dim, w.v + s.alpha * m.mu AS v"
            f" FROM w{p} w JOIN m{k} m USING (dim), s{k} s)"
        )
    return examples + ",\n" + ",\n".join(parts)


def full_batch(rounds: int, examples: str = DOC) -> str:
    plan = [("TRUE", k == 0, "zero") for k in range(rounds)]
    return cg_rounds(plan, examples=examples).replace(
        "w0 AS", "zero AS (SELECT dim, 0e0 AS v FROM dwt),\nw0 AS", 1
    )


def mini_batch(passes: int, batches: int, inner: int, anchored: bool = True) -> str:
    plan = []
    for _ in range(passes):
        for b in range(batches):
            centre = f"w{len(plan)}" if anchored else "w0"
            plan += [(f"id % {batches} = {b}", i == 0, centre) for i in range(inner)]
    return cg_rounds(plan)


def _moved(k: int) -> str:
    """How far round `k` moves the weights."""
    return f"(SELECT sqrt(sum((n.v - o.v) * (n.v - o.v))) FROM w{k} n JOIN w{k - 1} o USING (dim))"


def _stops() -> str:
    """Number of the first round that moves the weights by less than the bound, or of the last."""
    rounds = [f"WHEN {_moved(k)} < {STOP_EPS} THEN {k}" for k in range(1, STOP_ROUNDS)]
    return f"SELECT CAST(CASE {' '.join(rounds)} ELSE {STOP_ROUNDS} END AS BIGINT) AS rounds"


def _scaled(k: int) -> str:
    """A trace row of sums divided by the number of samples: steps grow by it, weights stay."""
    cells = {
        "alpha": "alpha * n",
        "beta": "beta",
        "w_diff_norm": _moved(k),
        "grad_norm": "sqrt(gg) / n",
        "gtd": "gtd / n / n",
        "uhu": "uhu / n / n / n",
    }
    shown = ", ".join(f"{rounded(v, SCALED_DIGITS[c])} AS {c}" for c, v in cells.items())
    return f"SELECT {k - 1} AS iter, {shown} FROM s{k}, b{k}, (SELECT CAST(sum(pos + neg) AS DOUBLE) AS n FROM doc)"


def _final(weights: str) -> str:
    """CTE `fin`: margins of all document examples under a weight table."""
    return (
        f"fin AS MATERIALIZED (SELECT id, any_value(pos) AS pos, any_value(neg) AS neg, sum(v) AS z"
        f" FROM dfeat JOIN {weights} USING (dim) GROUP BY id)"
    )


def _metrics(weights: str) -> str:
    value = (
        f"(5e-2 * (SELECT sum(v * v) FROM {weights}) + (SELECT sum({counted_loss()}) FROM fin))"
        f" / (SELECT sum(pos + neg) FROM fin)"
    )
    return (
        f"SELECT {rounded(acc('fin'), 6)} AS accuracy, {rounded(auc('fin'), 6)} AS auc,"
        f" {rounded(value, 6)} AS objective"
    )


def _trace(k: int) -> str:
    value = (
        f"(5e-2 * (SELECT sum(v * v) FROM w{k - 1}) + (SELECT sum({counted_loss()}) FROM z{k}))"
        f" / (SELECT sum(pos + neg) FROM z{k})"
    )
    columns = {
        "loglik": value,
        "alpha": "alpha",
        "beta": "beta",
        "w_norm": f"(SELECT sqrt(sum(v * v)) FROM w{k})",
        "w_diff_norm": _moved(k),
        "w0": f"(SELECT v FROM w{k} WHERE dim = 0)",
        "grad_norm": "sqrt(gg)",
        "gtd": "gtd",
        "uhu": "uhu",
        "gtold": "gtold",
    }
    cells = ", ".join(f"{rounded(v, 5)} AS {c}" for c, v in columns.items())
    return f"SELECT {k - 1} AS iter, {cells} FROM s{k}, b{k}"


def _averages() -> str:
    """CTEs a1..a3: mean of the weights after the first batches, in mini_batch(1, 3, 2)."""
    parts = ["a1 AS MATERIALIZED (SELECT dim, v FROM w2)"]
    parts.append("a2 AS MATERIALIZED (SELECT a.dim, (a.v + b.v) / 2e0 AS v FROM w2 a JOIN w4 b USING (dim))")
    parts.append(
        "a3 AS MATERIALIZED (SELECT a.dim, (a.v + b.v + c.v) / 3e0 AS v FROM w2 a"
        " JOIN w4 b USING (dim) JOIN w6 c USING (dim))"
    )
    for k in (1, 2, 3):
        parts.append(_final(f"a{k}").replace("fin AS", f"fin{k} AS"))
    return ", ".join(parts)


def _batch_trace() -> str:
    rows = []
    for b in range(3):
        for i in range(2):
            k = 2 * b + i + 1
            apart = f"(SELECT sum((n.v - o.v) * (n.v - o.v)) FROM w{k - 1} n JOIN w{2 * b} o USING (dim))"
            own = f"(5e-2 * {apart} + (SELECT sum({counted_loss()}) FROM z{k})) / (SELECT sum(pos + neg) FROM z{k})"
            whole = (
                f"(5e-2 * (SELECT sum(v * v) FROM a{b + 1}) + (SELECT sum({counted_loss()}) FROM fin{b + 1}))"
                f" / (SELECT sum(pos + neg) FROM fin{b + 1})"
            )
            rows.append(
                f"SELECT {b} AS batch, {i} AS iter, {rounded(own, 6)} AS loglik, {rounded(whole, 6)} AS avg_objective"
            )
    return " UNION ALL ".join(f"({r})" for r in rows)


TEXT_SOURCE = f"""
src AS (
  SELECT 4000000 + l_suppkey AS fid, CAST(l_partkey AS INTEGER) AS dim, l_orderkey, {SLOT_ORDER}
  FROM lineitem WHERE l_linenumber <> 7
)"""


def parity(line: str) -> str:
    """Closed form of the replacing histogram; `line` says which slots share a line."""
    return f"""
WITH {IMP},
s AS (SELECT *, {line} AS line FROM imp),
own AS (
  SELECT req, line, fid, max(seg) AS last_seg, arg_max("show", seg) AS last_show
  FROM (SELECT req, line, seg, "show", unnest([f1, f2, f3]) AS fid FROM s) GROUP BY req, line, fid
),
shared AS (SELECT req, line, seg, "show", unnest([c1, c2]) AS fid FROM s),
part AS (
  SELECT fid, last_show AS n FROM own
  UNION ALL
  SELECT shared.fid, "show" FROM shared LEFT JOIN own USING (req, line, fid)
  WHERE own.last_seg IS NULL OR seg > own.last_seg
)
SELECT fid, CAST(sum(n) AS BIGINT) AS n FROM part GROUP BY fid"""


LINES = f"""
li AS (
  SELECT row_number() OVER () AS id, CASE WHEN l_linenumber <> 7 THEN l_orderkey END AS req,
    CAST(l_linenumber AS INTEGER) AS seg, l_partkey % 3 AS pos, 3 - l_partkey % 3 AS neg,
    1152921504606846976 + l_suppkey AS f1,
    CASE WHEN l_linenumber > 2 THEN 5000000 + l_linenumber END AS f2 FROM lineitem
),
llong AS (SELECT id, pos, neg, unnest([f1, f2]) AS fid FROM li),
ldict AS (
  SELECT fid, CAST(row_number() OVER (ORDER BY fid) AS INTEGER) AS dim
  FROM (SELECT DISTINCT fid FROM llong WHERE fid % 2 = 0)
),
dfeat AS MATERIALIZED (
  SELECT id, pos, neg, dim FROM llong JOIN ldict USING (fid) UNION ALL SELECT id, pos, neg, 0 FROM li
),
dwt AS (SELECT dim FROM ldict UNION ALL SELECT 0)"""


def oracle_sql() -> dict[str, str]:
    line_rows = f"""WITH {LINES},
l AS (SELECT id, string_agg(CAST(dim AS VARCHAR), ' ' ORDER BY dim) AS dims FROM dfeat GROUP BY id)
SELECT req, seg, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg, dims, count(*) AS n
FROM li JOIN l USING (id) GROUP BY ALL"""
    line_weights = f"WITH {full_batch(2, LINES)} SELECT dim AS idx, {rounded('v', 6)} AS w FROM w2"
    impressions = f"""WITH {IMP}
SELECT req, seg, "show", click, concat_ws(' ', f1, f2, f3) AS feats, concat_ws(' ', c1, c2) AS common FROM imp"""
    hist = f"WITH {LONG} SELECT fid, n FROM hist"
    encoded = f"""WITH {FEAT}
SELECT req, seg, CAST(any_value(pos) AS BIGINT) AS pos, CAST(any_value(neg) AS BIGINT) AS neg,
  string_agg(CAST(dim AS VARCHAR), ' ' ORDER BY dim) AS dims
FROM feat JOIN ex USING (req, seg) GROUP BY req, seg"""
    margin = f"WITH {FEAT} SELECT req, seg, {rounded('z', 6)} AS z FROM marg"
    total_loss = f"WITH {FEAT} SELECT {rounded(f'sum({counted_loss()})', 4)} AS loss FROM marg"
    gradient = f"""WITH {FEAT},
res AS (SELECT req, seg, (pos + neg) * {sigma()} - pos AS r FROM marg)
SELECT dim AS idx, {rounded('sum(r)', 4)} AS g FROM feat JOIN res USING (req, seg) GROUP BY dim"""
    bend = f"sum((pos + neg) * {sigma()} * (1 - {sigma()}) * xm * xm)"
    curvature = f"WITH {FEAT} SELECT {rounded(bend, 4)} AS curvature FROM marg"
    iter1 = f"WITH {full_batch(1)} SELECT dim AS idx, {rounded('v', 6)} AS w FROM w1"
    iter2 = f"WITH {full_batch(2)} SELECT dim AS idx, {rounded('v', 6)} AS w FROM w2"
    average = (
        "avg_w AS MATERIALIZED (SELECT a.dim, (a.v + b.v + c.v) / 3e0 AS v FROM w2 a"
        " JOIN w4 b USING (dim) JOIN w6 c USING (dim))"
    )
    batches = f"WITH {mini_batch(1, 3, 2)}, {average}, {_final('avg_w')} {_metrics('avg_w')}"
    z = "((l_quantity - 25.5e0) * 2)"
    return {
        "impressions": impressions,
        "imp_parse": impressions,
        "imp_parse_offsets": f"SELECT * EXCLUDE (req), count(*) AS n FROM ({impressions}) GROUP BY ALL",
        "imp_parse_partitions": f"""SELECT * EXCLUDE (req), count(*) AS n, CAST(12 AS BIGINT) AS n_tasks
FROM ({impressions}) GROUP BY ALL""",
        "segment_combine": f"""WITH {IMP}
SELECT req, seg, "show", click, concat_ws(' ', f1, f2, f3, c1, c2) AS fids FROM imp""",
        "feature_hist": hist,
        "feature_hist_lines": hist,
        "feature_hist_parity": parity("0"),
        "feature_hist_parity_lines": parity("0"),
        "feature_dict": f"WITH {DICT} SELECT fid, n, dim FROM dict",
        "feature_dict_sketched": f"WITH {DICT} SELECT fid, n, dim FROM dict",
        "dict_load": f"""WITH {TEXT_SOURCE}
SELECT fid, dim FROM src QUALIFY row_number() OVER (PARTITION BY fid ORDER BY
  l_orderkey DESC, {', '.join(c + ' DESC' for c in SLOT_ORDER.split(', '))}) = 1""",
        "dict_load_reverse": f"""WITH {TEXT_SOURCE}
SELECT fid, dim FROM src QUALIFY row_number() OVER (PARTITION BY dim ORDER BY
  l_orderkey DESC, {', '.join(c + ' DESC' for c in SLOT_ORDER.split(', '))}) = 1""",
        "encode_examples": encoded,
        "encode_examples_join": encoded,
        "encode_examples_bloom": encoded,
        "samples_weighted": f"""WITH {FEAT}
SELECT req, seg, 1e0 AS y, CAST(pos AS BIGINT) AS wt FROM ex WHERE pos > 0
UNION ALL SELECT req, seg, -1e0, CAST(neg AS BIGINT) FROM ex WHERE neg > 0""",
        "samples_expanded": f"""WITH {IMP},
k AS (SELECT req, seg, click, unnest(generate_series(1, "show")) AS k FROM imp)
SELECT req, seg, CAST(k AS BIGINT) AS k, CASE WHEN k <= click THEN 1e0 ELSE -1e0 END AS y FROM k""",
        "data_stats": f"""WITH {FEAT}
SELECT CAST((SELECT sum(pos + neg) FROM ex) AS BIGINT) AS n, (SELECT max(dim) FROM feat) + 1 AS d,
  (SELECT max(dim) FROM dict) + 1 AS dict_d""",
        "sigmoid": f"""
SELECT l_orderkey, l_linenumber, {z} AS z, {rounded(sigma(z), 12)} AS sigma,
  {rounded(f'ln({sigma(z)})', 9)} AS ln_sigma, {rounded(loss(z), 9)} AS loss FROM lineitem""",
        "margin": margin,
        "margin_join": margin,
        "score": f"WITH {FEAT} SELECT req, seg, {rounded(sigma(), 9)} AS p FROM marg",
        "predict_label": f"""WITH {FEAT}
SELECT req, seg, CASE WHEN round(z, 9) < 0 THEN -1e0 ELSE 1e0 END AS label FROM marg""",
        "log_loss": total_loss,
        "log_loss_join": total_loss,
        "objective": f"""WITH {FEAT}
SELECT {rounded(f'(5e-2 * (SELECT sum(w * w) FROM wt) + sum({counted_loss()})) / sum(pos + neg)', 9)} AS objective,
  {rounded(f'sum({counted_loss()})', 4)} AS loss FROM marg""",
        "gradient": gradient,
        "gradient_join": gradient,
        "curvature": curvature,
        "curvature_join": curvature,
        "accuracy": f"WITH {DOC} SELECT {rounded(acc('dmarg'), 9)} AS accuracy",
        "accuracy_weighted": f"""WITH {FEAT}, m AS (SELECT pos, neg, round(z, 9) AS z FROM marg)
SELECT {rounded(acc('m'), 9)} AS accuracy""",
        "auc_roc": f"WITH {DOC} SELECT {rounded(auc('dmarg'), 9)} AS auc",
        "auc_roc_weighted": f"WITH {FEAT} SELECT {rounded(auc('marg'), 9)} AS auc",
        "weight_norms": f"""WITH {FEAT}
SELECT {rounded('sqrt(sum(w * w))', 9)} AS w_norm, {rounded('sqrt(sum(mu * mu))', 9)} AS mu_norm,
  {rounded('sum(w * mu)', 9)} AS w_mu FROM wt""",
        "weights_by_fid": f"""WITH {FEAT}
SELECT CAST(fid AS VARCHAR) AS fid, {rounded('w', 9)} AS w, dim = 0 AS is_bias
FROM wt LEFT JOIN dict USING (dim)""",
        "cg_iter1": iter1,
        "cg_iter1_join": iter1,
        "cg_iter2": iter2,
        "cg_iter2_join": iter2,
        "cg_trace": f"WITH {full_batch(5)} "
        + " UNION ALL ".join(f"({_trace(k)})" for k in range(1, 6)),
        "cg_trace_resumed": f"WITH {full_batch(5)} "
        + " UNION ALL ".join(f"({_trace(k)})" for k in range(1, 6)),
        "cg_iter2_store": iter2,
        "cg_fit_metrics": f"WITH {full_batch(5)}, {_final('w5')} {_metrics('w5')}",
        "cg_fit_clicks": f"WITH {full_batch(3, CLICKS)}, {_final('w3')} {_metrics('w3')}",
        "minibatch_sizes": f"""WITH {DOC}
SELECT count(*) AS n, count(DISTINCT id) AS n_ids, CAST(0 AS BIGINT) AS n_outside,
  CAST(sum(pos + neg) // 100 + 1 AS BIGINT) AS n_batches FROM doc""",
        "minibatch_fit_metrics": batches,
        "minibatch_fit_metrics_join": batches,
        "minibatch_zero_metrics": f"WITH {mini_batch(1, 3, 2, False)}, {average}, {_final('avg_w')} {_metrics('avg_w')}",
        "minibatch_trace": f"WITH {mini_batch(1, 3, 2)}, {_averages()} " + _batch_trace(),
        "encode_line_keys": line_rows,
        "encode_line_keys_join": line_rows,
        "cg_iter2_line_keys": line_weights,
        "cg_iter2_line_keys_join": line_weights,
        "score_beyond_model": f"""WITH {FEAT}
SELECT req, seg, {rounded('coalesce(sum(w) FILTER (dim < 10), 0)', 6)} AS z
FROM feat LEFT JOIN wt USING (dim) GROUP BY req, seg""",
        "imp_parse_dropmalformed": impressions + " WHERE req % 5 <> 0",
        "imp_parse_permissive": f"""WITH {IMP}
SELECT req, req % 5 = 0 AS corrupt, CASE WHEN req % 5 <> 0 THEN CAST(count(*) + 1 AS INTEGER) END AS n_segments
FROM imp GROUP BY req""",
        "libsvm_minibatch": """
SELECT count(*) AS n, CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
  CAST(sum(CASE WHEN l_discount > 0.05 THEN 0 ELSE 1 END) AS BIGINT) AS neg, CAST(4 AS BIGINT) AS n_batches
FROM lineitem WHERE l_linenumber <> 7""",
        "jobs_fit": f"""WITH {full_batch(5)}, {_final('w5')}
SELECT {rounded(acc('fin'), 6)} AS accuracy, {rounded(auc('fin', 12), 6)} AS auc""",
        "jobs_test": f"""WITH {full_batch(5)}, {_final('w5')}
SELECT {rounded(acc('fin'), 6)} AS accuracy, {rounded(auc('fin', 12), 6)} AS auc""",
        "export_tables": f"""WITH {full_batch(2)}
SELECT CAST(fid AS VARCHAR) AS fid, {rounded('v', 6)} AS w, dim = 0 AS is_bias
FROM w2 LEFT JOIN ddict USING (dim)""",
        "dictionary_text": f"WITH {DICT} SELECT concat_ws(' ', fid, dim) AS value FROM dict",
        "histogram_text": f"WITH {LONG} SELECT concat_ws(' ', fid, n) AS value FROM hist",
        "weights_text": f"""WITH {DICT}, t AS (SELECT max(dim) AS top FROM dict WHERE fid >= 4000000),
i AS (SELECT unnest(range(0, top + 1)) AS i FROM t)
SELECT CAST(CASE WHEN fid >= 4000000 THEN CAST(i % 7 AS DOUBLE) ELSE 0e0 END AS VARCHAR) AS value
FROM i LEFT JOIN dict ON dim = i""",
        "feature_weights_text": f"""WITH {DICT}
SELECT concat_ws(' ', fid, CAST(CAST(dim % 7 AS DOUBLE) AS VARCHAR)) AS value
FROM (SELECT fid, dim FROM dict UNION ALL SELECT 0, 0)""",
        "samples_text": f"""WITH {FEAT},
l AS (SELECT req, seg, string_agg(CAST(dim AS VARCHAR), ' ' ORDER BY dim) AS dims FROM feat GROUP BY req, seg)
SELECT y || chr(10) || dims || chr(10) AS value FROM l JOIN (
  SELECT req, seg, '1.0' AS y FROM ex WHERE pos > 0 UNION ALL SELECT req, seg, '-1.0' FROM ex WHERE neg > 0
) USING (req, seg)""",
        "cg_stops": f"WITH {full_batch(STOP_ROUNDS)} " + _stops(),
        "cg_trace_scaled": f"WITH {full_batch(3)} " + " UNION ALL ".join(f"({_scaled(k)})" for k in range(1, 4)),
        "unsigned_roundtrip": """
WITH v AS (
  SELECT l_orderkey, l_linenumber, l_partkey,
    CASE WHEN l_linenumber % 2 = 1
      THEN CAST(18446744073709551615 AS HUGEINT) - (l_orderkey * 10000000 + l_partkey)
      ELSE CAST(l_orderkey * 10000000 + l_partkey AS HUGEINT) END AS u
  FROM lineitem
)
SELECT l_orderkey, l_linenumber, l_partkey,
  CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS bits,
  CAST(u AS VARCHAR) AS text FROM v""",
        "libsvm_binary_load": f"""
SELECT l_orderkey AS id, CASE WHEN l_discount > 0.05 THEN 1e0 ELSE -1e0 END AS y,
  concat_ws(' ', 0, l_partkey, l_suppkey, l_linenumber) AS idx FROM lineitem WHERE l_linenumber <> 7""",
    }
