from pyspark.sql import functions as F

from quillgraph.functions import replies
from quillgraph.operators import construction


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_channels(spark):
    t = "<|channel|>analysis<|message|>hm<|end|><|channel|>final<|message|> Yes <|end|>"
    assert one(spark, replies.without_channels(F.lit(t))) == "Yes"
    assert one(spark, replies.without_channels(F.lit("<|channel|>analysis<|message|>hm<|end|> rest <|start|>x"))) == "rest"
    assert one(spark, replies.without_channels(F.lit("plain"))) == "plain"
    odd = {
        "a <|channel|>analysis<|message|>x<|channel|>final<|message|>Yes<|end|> b": "a  b", "<|channel|>final <|constrain|>json<|message|> {1} <|end|><|channel|>final<|message|>two\n<|end|>": "{1}\ntwo",
        "x < y <|channel|>commentary to=functions.think": "x < y", "<|channel|>": "", "p<|end|>q<r <|channel|>!<|message|>m<|end|>": "p<r",
    }
    for t, want in odd.items():
        assert one(spark, replies.without_channels(F.lit(t))) == want, t
    assert one(spark, replies.without_channels(F.lit(None).cast("string"))) is None


def test_json(spark):
    assert one(spark, replies.json_part(F.lit('x {"a": {"b": 1}} y'))) == '{"a": {"b": 1}}' and one(spark, replies.json_part(F.lit("{x"))) is None
    assert one(spark, replies.fenced_json(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}' and one(spark, replies.fenced_json(F.lit('{"a": 2}'))) == '{"a": 2}'


def test_lines(spark):
    assert one(spark, replies.status_line(F.lit(2), F.lit(12345), F.lit(7))) == "\nTurn: 3  |  Tokens used: 12,345  |  Budget used: 7"
    assert "B. y" in one(spark, replies.choice_prompt(F.lit("c"), F.lit("q"), F.array(F.lit("x"), F.lit("y"))))


def test_model_calls_keep_order_and_survive_failures(spark):
    def client(prompts):
        if "boom" in prompts:
            raise ValueError
        return [None if p == "no" else p.upper() for p in prompts]

    d = spark.createDataFrame([(1, "a"), (2, "no"), (3, "b"), (4, "boom")], "id long, prompt string").coalesce(1)
    out = {r.id: r.reply for r in construction.ask_model(d, client, batch=3, failed="F").collect()}
    assert out == {1: "A", 2: "F", 3: "B", 4: "F"}


def test_siblings(spark):
    s = spark.createDataFrame([(1, 1, "t", "t"), (1, 2, "x", "t"), (1, 3, "y", "t"), (1, 4, "z", "t"), (1, 5, "w", "t")], "qid long, pos int, arxiv_id string, target string")
    pool = spark.createDataFrame([("y",), ("w",), ("t",)], "arxiv_id string")
    assert construction.sibling_choice(s, pool).collect()[0].sibling == "y"
