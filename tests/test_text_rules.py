"""Literal edge rows of the parsers and rewards, and random texts against small Python twins."""

import random
import re

import pytest
from pyspark.sql import functions as F

from episodica.functions import equation, numbers, parse, quantize, rewards, text

FORMAT_ROWS = [
    ("0.5,0.5</action>", 1.0), ("0.5,0.5</action>\n", 0.9), ("0.5,0.5", 0.0), ("0.5,0.5</action> ok", -0.3),
    ("0.5,0.5</action></action>", 1.0), ("0.5</action>", -9.0), ("0.5", -10.0), ("1,2</action>", -10.0),
    (" 0.5,0.5</action>", -10.0), ("", -10.0),
]
DISCRETE_ROWS = [
    ("1</action>", 1.0, 0.0), ("0</action>", 1.0, -1.0), ("1</action> ok", -0.3, 0.0), ("2</action>", -10.0, -10.0),
    ("1", -10.0, -10.0), ("1</action></action>", 0.1, 0.0),
]


def column(spark, texts, *columns):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", *columns)
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in sorted(rows.collect())]


def test_format_continuous(spark):
    got = column(spark, [t for t, _ in FORMAT_ROWS], rewards.reward_format_continuous(F.col("t"), 2))
    assert got == pytest.approx([e for _, e in FORMAT_ROWS])


def test_discrete_rewards(spark):
    got = column(spark, [t for t, *_ in DISCRETE_ROWS], rewards.reward_format_discrete(F.col("t"), 2),
                 rewards.reward_bc_discrete(F.col("t"), F.lit(1), 2))
    assert [g for g, _ in got] == pytest.approx([f for _, f, _ in DISCRETE_ROWS])
    assert [b for _, b in got] == pytest.approx([b for _, _, b in DISCRETE_ROWS])
    with pytest.raises(ValueError):
        parse.discrete_pattern(11)


def test_extractors(spark):
    assert column(spark, [" 1, -.5 x", "1", "", "1,2,3"], parse.extract_action_continuous(F.col("t"), 2)) == [
        [1.0, -0.5], None, None, None]
    assert column(spark, ["0,999", "0,1000", "0", "x"], parse.extract_action_tokenized(F.col("t"), 2)) == [
        [-1.0, 1.0], None, None, None]
    assert column(spark, ["7", "", "x"], parse.extract_action_continuous(F.col("t"), 1)) == [[7.0], None, None]
    lenient = column(spark, ["<action>,1,2,3,4,5,6x</action> 9", "1,2", "a<action>1,2,3,4,5,-</action>"],
                     parse.extract_action_lenient(F.col("t")))
    assert lenient[0]["action"] == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    assert lenient[1]["error"] == "expected 6 values, got 2" and lenient[2]["error"] == "not a number"


def test_quantize_round_trip(spark):
    ranges = quantize.ranges_literal([(0.0, 1.0)] * 3 + [(2.0, 2.0)])
    row = spark.range(1).select(quantize.quantize_obs(
        F.array(F.lit(0.5), F.lit(2.0), F.lit(-1.0), F.lit(2.0)), ranges).alias("q")).first()
    assert row["q"] == [499, 999, 0, 0]
    back = spark.range(1000).select(F.col("id"), quantize.dequantize_action(
        quantize.quantize_obs(F.array(F.col("id") / 1000.0), quantize.ranges_literal([(0.0, 1.0)])),
        quantize.ranges_literal([(0.0, 1.0)]))[0].alias("x"))
    assert back.where(F.abs(F.col("x") - F.col("id") / 1000.0) > 1 / 999).count() == 0


def test_number_text_equals_printf(spark):
    rng = random.Random(3)
    values = [0.123455, 2.000015, -0.0, -1e-7, 1e-5, float("nan"), float("inf"), 123456789.123455]
    values += [round(rng.uniform(-5, 5), 6) for _ in range(2000)] + [rng.uniform(-50, 50) for _ in range(2000)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", numbers.fixed(F.col("x")).alias("s"))
    assert all(r["s"] == "%.5f" % r["x"] for r in rows.collect())


def test_parsers_raise_on_bad_numbers(spark):
    bad = spark.createDataFrame([("<observation>1,x</observation>",)], "t string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        bad.select(parse.parse_tagged_vector(F.col("t"), "<observation>", "</observation>")).collect()
    lenient = parse.parse_tagged_vector(F.col("t"), "<observation>", "</observation>", strict=False)
    assert bad.select(lenient.alias("v")).first()["v"] is None
    with pytest.raises(Exception, match="Expected 3 observations, got 2"):
        spark.createDataFrame([("[1, 2]",)], "t string").select(parse.parse_bracket_vector(F.col("t"), 3)).collect()


EQUATIONS = [
    ("<answer>1+2*3</answer>", 7.0, [1, 2, 3], 1.0), ("<answer>(1+2)*3</answer>", 9.0, [3, 2, 1], 1.0),
    ("<answer>1+2*3</answer>", 8.0, [1, 2, 3], 0.0), ("<answer>1+2</answer>", 3.0, [1, 2, 3], 0.0),
    ("<answer>2**3</answer>", 8.0, [2, 3], 1.0), ("<answer>7//2</answer>", 3.0, [7, 2], 1.0),
    ("<answer>3.5</answer>", 3.5, [3, 5], 1.0), ("<answer>9**9**9**9</answer>", 1.0, [9, 9, 9, 9], 0.0),
    ("<answer>1/0</answer>", 1.0, [1, 0], 0.0), ("<answer>(1)(2)</answer>", 2.0, [1, 2], 0.0),
    ("<answer>-1+2</answer>", 1.0, [1, 2], 1.0), ("<answer>1+\n2</answer>", 3.0, [1, 2], 0.0),
    ("1+2", 3.0, [1, 2], 0.0), ("<answer> 1 + 2 </answer><answer>9</answer>", 3.0, [1, 2], 1.0),
    ("<answer>03+1</answer>", 4.0, [3, 1], 0.0), ("<answer></answer>", 0.0, [], 0.0),
]


def test_equation_reward(spark):
    rows = spark.createDataFrame([(i, *e) for i, e in enumerate(EQUATIONS)],
                                 "i int, c string, t double, n array<int>, e double")
    got = rows.select("c", "e", equation.reward_equation(F.col("c"), F.col("t"), F.col("n")).alias("r")).collect()
    assert [(r["c"], r["r"]) for r in got] == [(r["c"], r["e"]) for r in got]


def format_twin(response, n, pattern):
    found = re.search(pattern, response, re.DOTALL)
    if not found:
        return -10.0
    score = -len("".join(response.split("</action>")[1:])) / 10 if found.group(1).count(",") + 1 == n else -10.0
    return score + (1.0 if re.search("</action>$", response, re.DOTALL) else 0.0)


def test_format_rewards_on_random_texts(spark):
    rng = random.Random(5)
    pieces = ["0.5", "-1.25", ".5", "12", "999", "1000", ",", ", ", " ", "</action>", "<action>", "\n", "ok", "-", "+"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 9))) for _ in range(4000)]
    got = column(spark, texts, rewards.reward_format_continuous(F.col("t"), 2),
                 rewards.reward_format_tokenized(F.col("t"), 2))
    assert [g[0] for g in got] == pytest.approx([format_twin(t, 2, parse.DECIMAL_LIST) for t in texts])
    assert [g[1] for g in got] == pytest.approx([format_twin(t, 2, parse.INTEGER_LIST) for t in texts])


def test_python_reward_and_registry(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, "abc")], "k int, completion string")
    registry = rewards.RewardRegistry()
    registry.register("length", ["completion"], lambda c: rewards.python_reward(
        lambda completions: [float(len(c)) for c in completions], {"completions": c}))
    registry.register("key", ["k"], lambda k: k * 10.0)
    assert [r["reward"] for r in registry.score(rows).orderBy("k").collect()] == [12.0, 23.0]
    with pytest.raises(ValueError, match="needs columns"):
        registry.score(rows.drop("k"))


def test_text_helpers(spark):
    one = spark.range(1)
    assert one.select(text.truncate_text(F.lit(" a  b\tc "), 2).alias("x")).first()["x"] == "b c"
    assert one.select(text.truncate_text(F.lit("a b"), 5).alias("x")).first()["x"] == "a b"
    assert one.select(text.model_short_name(F.lit("m--o--name/final_model/x")).alias("x")).first()["x"] == "name"
    with pytest.raises(Exception, match="environment not supported"):
        one.select(text.select_system_prompt(F.lit("Hopper"), strict=True)).collect()
