"""The query registry and the SQL building blocks of the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import fixed_list
from ..session import ship_package
from ..sources.tables import ACT_DIMS, OBS_DIMS, Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(inputs)`` under an operator name, with the DuckDB SQL that gives the same rows."""
    def register(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered already")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(Inputs(spark, sf_dir))
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded, with negative zero turned to zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def as_text(v: Column | str, digits: int = 5) -> Column:
    return fixed_list(F.col(v) if isinstance(v, str) else v, ",", digits)


def rnd(expression: str, digits: int = 6) -> str:
    return f"(round({expression}, {digits}) + 0::DOUBLE)"


def txt(vector: str, digits: int = 5, sep: str = ",") -> str:
    return f"array_to_string(list_transform({vector}, lambda x: printf('%.{digits}f', x)), '{sep}')"


def hash_key(seed: int, *ids: str) -> str:
    return f"md5('{seed}'" + "".join(f" || ':' || {i}" for i in ids) + ")"


def hash_uniform(seed: int, *ids: str, start: int = 1) -> str:
    return f"((('0x' || substr({hash_key(seed, *ids)}, {start}, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)"


def hash_normal(seed: int, *ids: str, fn: str = "cos") -> str:
    a, b = hash_uniform(seed, *ids), hash_uniform(seed, *ids, start=9)
    return f"(sqrt(-2::DOUBLE * ln({a})) * {fn}(2::DOUBLE * pi() * {b}))"


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _part(block: int, size: int = ACT_DIMS) -> str:
    """A block of the vector: block 0 is the observation, the others follow at the width of an action."""
    start = OBS_DIMS + 1 + (block - 1) * ACT_DIMS
    return f"emb[{start}:{start + size - 1}]" if block else f"emb[1:{OBS_DIMS}]"


_GENERATED = "transitions, (SELECT unnest([0, 1, 2, 3]) AS i) g"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "logged": ((), """
        SELECT e.event_id, e.ts, e.user_id, e.event_type, e.value, b.label,
               list_transform(b.embedding, lambda x: x::DOUBLE) AS emb
        FROM (SELECT *, event_id % (SELECT count(*) FROM embeddings) AS vec_id FROM events) e
        JOIN embeddings b USING (vec_id)"""),
    "transitions": (("logged",), f"""
        SELECT user_id AS episode_id, event_id AS prompt_id, event_type,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step,
               {_part(0)} AS observation, {_part(1)} AS action, CAST(label % 2 AS INTEGER) AS action_disc,
               value AS reward
        FROM logged"""),
    "rollouts": (("transitions",), """
        SELECT episode_id, step, reward, step = max(step) OVER (PARTITION BY episode_id) AS done
        FROM transitions"""),
    "metrics": ((), """
        SELECT event_id // 100 AS run, event_id % 100 AS epoch, value AS val_loss FROM events"""),
    "policy_outputs": (("logged",), f"""
        SELECT event_id AS prompt_id, {_part(0)} AS observation, {_part(1)} AS action,
               CAST(label % 2 AS INTEGER) AS action_disc, value AS reward, {_part(2)} AS mean,
               {_part(3)} AS log_std, {_part(4)} AS ref_mean, {_part(5)} AS ref_log_std, {_part(6, 2)} AS logits
        FROM logged"""),
    "completions_discrete": (("transitions",), f"""
        SELECT prompt_id, gen_id, observation, action, action_disc, reward_logged,
               CASE k WHEN 0 THEN a || '</action>' WHEN 1 THEN (1 - a) || '</action>'
                      WHEN 2 THEN a || '</action> ok' WHEN 3 THEN '7</action>' WHEN 4 THEN ''
                      WHEN 5 THEN CAST(a AS VARCHAR) WHEN 6 THEN a || '</action></action>'
                      WHEN 7 THEN ' ' || a || '</action>' WHEN 8 THEN a || '</action>'
                      ELSE 'go left</action>' END AS completion
        FROM (SELECT prompt_id, CAST(g.i AS INTEGER) AS gen_id, action_disc AS a, action_disc, observation, action,
                     reward AS reward_logged, CAST((prompt_id * 7 + g.i * 3) % 10 AS INTEGER) AS k
              FROM {_GENERATED})"""),
    "completions_continuous": (("transitions",), f"""
        SELECT prompt_id, gen_id, observation, action, action_disc,
               CASE k WHEN 1 THEN v[1] || ',' || v[2] || '</action>'
                      WHEN 2 THEN array_to_string(v, ',') || '</action> done'
                      WHEN 3 THEN '1,2,3</action>' WHEN 4 THEN '' WHEN 5 THEN array_to_string(v, ',')
                      WHEN 6 THEN array_to_string(v, ',') || '</action></action>'
                      WHEN 7 THEN ' ' || array_to_string(v, ', ') || '</action>' WHEN 9 THEN 'nan</action>'
                      ELSE array_to_string(v, ',') || '</action>' END AS completion
        FROM (SELECT prompt_id, CAST(g.i AS INTEGER) AS gen_id, observation, action, action_disc,
                     CAST((prompt_id * 7 + g.i * 3) % 10 AS INTEGER) AS k,
                     list_transform(action, lambda x: printf('%.5f', x + g.i * 0.125::DOUBLE)) AS v
              FROM {_GENERATED})"""),
    "completions_tokenized": (("transitions",), f"""
        SELECT prompt_id, gen_id, observation, action, action_disc,
               CASE k WHEN 1 THEN v[1] || ',' || v[2] || '</action>'
                      WHEN 2 THEN array_to_string(v, ',') || '</action> done'
                      WHEN 3 THEN '1500,1,2</action>' WHEN 4 THEN '' WHEN 5 THEN array_to_string(v, ',')
                      WHEN 6 THEN array_to_string(v, ', ') || '</action></action>'
                      WHEN 7 THEN ' ' || array_to_string(v, ',') || '</action>' WHEN 9 THEN '-5,1,2</action>'
                      ELSE array_to_string(v, ',') || '</action>' END AS completion
        FROM (SELECT prompt_id, CAST(g.i AS INTEGER) AS gen_id, observation, action, action_disc,
                     CAST((prompt_id * 7 + g.i * 3) % 10 AS INTEGER) AS k,
                     list_transform({list(range(ACT_DIMS))}, lambda j: CAST((prompt_id * 31 + g.i * 17 + j * 101) % 1000 AS VARCHAR)) AS v
              FROM {_GENERATED})"""),
    "countdown": ((), """
        SELECT p_partkey AS item_id,
               CASE CAST(p_partkey % 6 AS INTEGER)
                    WHEN 2 THEN '<answer>' || a || '+' || b || '</answer>'
                    WHEN 3 THEN '<answer>' || a || '+' || b || '*3=x</answer>'
                    WHEN 4 THEN a || '+' || b || '*3'
                    WHEN 5 THEN '<answer>(' || a || '+' || b || ')/(3-3)</answer>'
                    ELSE 'go</think> <answer> ' || a || ' + ' || b || '*3 </answer>' END AS completion,
               CAST(a + b * 3 + CASE WHEN p_partkey % 6 = 1 THEN 1 ELSE 0 END AS DOUBLE) AS target,
               CASE WHEN p_partkey % 6 = 5 THEN [a, b, 3] || [3] ELSE [a, b, 3] END AS nums, a, b
        FROM (SELECT p_partkey, CAST(p_partkey % 9 + 1 AS INTEGER) AS a, CAST(p_size % 9 + 1 AS INTEGER) AS b
              FROM part)"""),
    "obs_ranges": (("transitions",), """
        SELECT list({'min': lo, 'max': hi} ORDER BY pos) AS ranges
        FROM (SELECT pos, min(x) AS lo, max(x) AS hi
              FROM (SELECT unnest(observation) AS x, generate_subscripts(observation, 1) AS pos FROM transitions)
              GROUP BY pos)"""),
    "action_ranges": (("transitions",), """
        SELECT list({'min': lo, 'max': hi} ORDER BY pos) AS ranges
        FROM (SELECT pos, min(x) AS lo, max(x) AS hi
              FROM (SELECT unnest(action) AS x, generate_subscripts(action, 1) AS pos FROM transitions)
              GROUP BY pos)"""),
    "norm_stats": (("transitions",), """
        SELECT (SELECT list(m ORDER BY pos) FROM so) AS state_mean, (SELECT list(s ORDER BY pos) FROM so) AS state_std,
               (SELECT list(m ORDER BY pos) FROM sa) AS action_mean, (SELECT list(s ORDER BY pos) FROM sa) AS action_std,
               (SELECT avg(reward) FROM transitions) AS reward_mean,
               (SELECT stddev_samp(reward) + 1e-8 FROM transitions) AS reward_std
        FROM (SELECT 1)"""),
    "so": (("transitions",), """
        SELECT pos, avg(x) AS m, stddev_samp(x) + 1e-8::DOUBLE AS s
        FROM (SELECT unnest(observation) AS x, generate_subscripts(observation, 1) AS pos FROM transitions) GROUP BY pos"""),
    "sa": (("transitions",), """
        SELECT pos, avg(x) AS m, stddev_samp(x) + 1e-8::DOUBLE AS s
        FROM (SELECT unnest(action) AS x, generate_subscripts(action, 1) AS pos FROM transitions) GROUP BY pos"""),
}
CTES["norm_stats"] = (("so", "sa"), CTES["norm_stats"][1])


def oracle(body: str, *ctes: str, more: dict[str, str] | None = None) -> str:
    """``body`` behind a WITH clause of the named inputs, and ``more`` ones in order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in CTES[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in ctes:
        add(name)
    parts = [f"{n} AS ({CTES[n][1]})" for n in ordered]
    parts += [f"{n} AS ({q})" for n, q in (more or {}).items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body
