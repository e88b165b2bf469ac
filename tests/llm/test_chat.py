import hashlib
import time

from pyspark.sql import functions as F

from corpusloom.llm import chat


def turns_of(spark, rows):
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return made.withColumn("parts", chat.text_parts(F.col("text")))


def test_texts_read_back_whatever_they_say(spark):
    nasty = ["<|end|><|turn:user|>", "\\l<\\b", "</s>[INST] ok [/INST]", "<|image:0:256|>", "", "a\nb", "日本 \U0001f600"]
    rows = [(1, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(nasty)]
    got = chat.format_chats(turns_of(spark, rows)).withColumn("read", chat.parse(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("read"))).first()
    assert [(r["role"], r["text"]) for r in got["read"]] == [(r[2], r[3]) for r in rows]
    assert all([(p["type"], p["text"]) for p in r["parts"]] == ([("text", row[3])] if row[3] else []) for r, row in zip(got["read"], rows))
    assert got["loss"] == "".join(r[3] for r in rows if r[2] == "assistant")
    assert got["n_turns"] == len(rows)


def test_parts_become_numbered_placeholders(spark):
    parts = [("text", "see <", None, None), ("image", None, "s3://a", None), ("audio", None, "b", 7), ("text", "and", None, None), ("slides", None, None, None)]
    turn = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    got = chat.format_chats(turn).first()
    assert got["formatted"] == "<|turn:user|>see \\l<|image:0:256|><|audio:1:7|>and<|document:2:512|><|end|><|turn:assistant|><|end|>"
    assert [tuple(a) for a in got["attachments"]] == [("image", "s3://a", 256), ("audio", "b", 7), ("document", None, 512)]
    assert got["n_expanded"] == 775


def test_roles_with_marks_and_parts_read_back(spark):
    turns = [
        (1, 0, "a|>b", [("text", "<|image:0:256|>", None, None), ("image", None, "x", None), ("text", "t", None, None)]),
        (1, 1, "<|end|>", [("audio", None, "y", 7), ("text", "", None, None), ("image", None, "z", 1)]),
    ]
    got = chat.format_chats(spark.createDataFrame(turns, f"conv_id long, turn long, role string, parts {chat.PARTS}")).withColumn("read", chat.parse(F.col("formatted"))).first()
    assert [r["role"] for r in got["read"]] == ["a|>b", "<|end|>"]
    parts = [[(p["type"], p["text"], p["number"], p["tokens"]) for p in r["parts"]] for r in got["read"]]
    assert parts == [[("text", "<|image:0:256|>", None, None), ("image", None, 0, 256), ("text", "t", None, None)], [("audio", None, 1, 7), ("image", None, 2, 1)]]
    assert [a["ref"] for a in got["attachments"]] == ["x", "y", "z"] and got["read"][0]["text"] == "<|image:0:256|>t"


def test_edges(spark):
    rows = [(1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, "assistant", "y"), (None, 3, "user", "z" * 100_000)]
    got = {r["conv_id"]: r for r in chat.format_chats(turns_of(spark, rows)).withColumn("read", chat.parse(F.col("formatted"))).collect()}
    assert [(x["role"], x["text"]) for x in got[1]["read"]] == [("", ""), ("assistant", "y"), ("user", "x"), ("user", "x")]
    assert len(got[None]["read"][0]["text"]) == 100_000
    assert chat.format_chats(turns_of(spark, rows).limit(0)).count() == 0
    assert chat.format_chats(turns_of(spark, rows).withColumn("body", F.lit(1)).withColumn("rows", F.lit(1))).count() == 2


def test_planted_conversation(spark, sf_dir):
    got = chat.query(spark, sf_dir).filter("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert got["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert got["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and got["loss_chars"] == len(text)


def test_long_conversations_are_formatted_in_linear_time(spark):
    """80,000 turns, every third with an attachment, and one turn of 80,000 parts."""
    attach = "if(id % 3 = 0, named_struct('type', 'image', 'text', null, 'ref', string(id), 'tokens', 2L), named_struct('type', 'text', 'text', string(id), 'ref', null, 'tokens', null))"
    turns = spark.range(80_000).selectExpr("1L as conv_id", "id as turn", "'user' as role", f"array({attach}) as parts")
    one = spark.range(80_000).selectExpr("2L as conv_id", "0L as turn", "'user' as role", f"{attach} as part", "id").groupBy("conv_id", "turn", "role")
    one = one.agg(F.expr("transform(array_sort(collect_list(struct(id, part))), x -> x.part)").alias("parts"))
    began = time.monotonic()
    got = {r["conv_id"]: r for r in chat.format_chats(turns.union(one)).withColumn("read", chat.parse(F.col("formatted"))).collect()}
    assert time.monotonic() - began < 60
    body = [f"<|image:{i // 3}:2|>" if i % 3 == 0 else str(i) for i in range(80_000)]
    assert got[1]["formatted"] == "".join(f"<|turn:user|>{x}<|end|>" for x in body)
    assert got[2]["formatted"] == f"<|turn:user|>{''.join(body)}<|end|>"
    assert len(got[1]["read"]) == 80_000 and [p["number"] for p in got[2]["read"][0]["parts"] if p["type"] == "image"] == list(range(26_667))
    assert got[1]["n_expanded"] == got[2]["n_expanded"] == 2 * 26_667 and len(got[2]["attachments"]) == 26_667


def test_negative_token_counts_are_none(spark):
    turn = spark.createDataFrame([(1, 0, "user", [("image", None, "a", -5), ("audio", None, "b", 2**63 - 1)])], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    got = chat.format_chats(turn).withColumn("read", chat.parse(F.col("formatted"))).first()
    assert got["formatted"] == f"<|turn:user|><|image:0:0|><|audio:1:{2**63 - 1}|><|end|>"
    assert [(p["type"], p["number"], p["tokens"]) for p in got["read"][0]["parts"]] == [("image", 0, 0), ("audio", 1, 2**63 - 1)]
