import hashlib
import random

from pyspark.sql import functions as F
from tidepack.llm.chat import escape, parse, read_back, render, unescape

SCHEMA = "conv_id long, turn long, role string, text string, formatted int"


def test_round_trip_against_plain_python(spark):
    rng = random.Random(7)
    bits = ["[INST]", "[/INST]", "</s>", "<s>", "\\", "[\\INST]", "[\\\\/INST]", "<\\/s>", "\n", "é😀", " ok ", "", "user\n", "%41", "[", "/INST]", "$1"]
    rows = []
    for c in range(120):
        for t in range(rng.randint(1, 6)):
            text = None if rng.random() < 0.05 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 7)))
            rows.append((c if c else None, t, rng.choice(["user", "assistant", "system", None, "odd\n[INST]% é", ""]), text, 1))
    rows += [(3, 0, "user", "twice", 1)] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    out = render(df)
    assert out.filter("not round_trip or round_trip is null").count() == 0
    got = {r.conv_id: r for r in read_back(out).collect()}
    text = {r.conv_id: r.formatted for r in out.collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        said = "".join(f"{role}\n{body}\n" for _, role, body in turns)
        loss = "".join(body for _, role, body in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars, r.formatted_chars) == (len(turns), len(loss), len(text[conv]))
        assert (r.turns_sha256, r.loss_sha256) == (hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(loss.encode()).hexdigest())
        assert text[conv].count("[/INST]") == len(turns)
    spans = {r.conv_id: "".join(text[r.conv_id][s.start : s.end] for s in r.loss_spans) for r in out.collect()}
    one = spark.createDataFrame([(c, t) for c, t in spans.items()], "conv_id long, t string").select("conv_id", unescape(F.col("t")).alias("t"))
    assert {r.conv_id: hashlib.sha256(r.t.encode()).hexdigest() for r in one.collect()} == {c: got[c].loss_sha256 for c in got}


def test_escape_is_reversible_and_leaves_plain_text(spark):
    texts = ["plain [text] <b>", "</s>[INST] ok [/INST]", "[\\\\INST]<\\s>", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u for r in got)
    assert got[0].e == texts[0] and "[/INST]" not in got[1].e and "</s>" not in got[1].e


def test_parser_rejects_what_fits_no_grammar(spark):
    got = spark.createDataFrame([("no turn[/INST]</s>",), ("[INST]user\nx[INST]y[/INST]</s>",)], "f string").select(parse(F.col("f")).alias("p")).collect()
    assert all(r.p[0].role is None for r in got)


def test_chat_empty(spark):
    assert read_back(render(spark.createDataFrame([], SCHEMA))).count() == 0


def test_a_shifted_mask_gives_no_loss(spark):
    rows = [(1, 0, "user", "aa", 1), (1, 1, "assistant", "[INST] bb", 1), (1, 2, "user", "", 1), (1, 3, "assistant", "cc", 1)]
    out = render(spark.createDataFrame(rows, SCHEMA))
    right = read_back(out).first()
    assert right.loss_chars == 11 and right.loss_sha256 == hashlib.sha256(b"[INST] bbcc").hexdigest()
    for i in range(2):
        for by in (-7, -1, 1):
            moved = F.transform("loss_spans", lambda s, k: F.struct((s["start"] + F.when(k == i, by).otherwise(0)).alias("start"), (s["end"] + F.when(k == i, by).otherwise(0)).alias("end")))
            got = read_back(out.withColumn("loss_spans", moved)).first()
            assert got.loss_sha256 is None and got.loss_chars is None and got.turns_sha256 == right.turns_sha256
    for spans in ("slice(loss_spans, 1, 1)", "loss_spans || slice(loss_spans, 1, 1)"):
        assert read_back(out.withColumn("loss_spans", F.expr(spans))).first().loss_sha256 != right.loss_sha256
    other = [s.asDict() for s in out.first().loss_spans][0]
    user = F.array(F.struct(F.lit(len("[INST]user\n")).cast("long").alias("start"), F.lit(len("[INST]user\naa")).cast("long").alias("end")))
    assert other["start"] > 13 and read_back(out.withColumn("loss_spans", user)).first().loss_sha256 == hashlib.sha256(b"aa").hexdigest()


def test_long_conversations_and_texts(spark):
    rows = [(None, t, "assistant" if t % 2 else "user", f"</s> {t}", 1) for t in range(3000)] + [(2, 0, "assistant", "é[INST]" * 50_000, 1)]
    out = render(spark.createDataFrame(rows, SCHEMA))
    got = {r.conv_id: r for r in read_back(out).collect()}
    assert got[None].n_turns == 3000 and got[2].loss_chars == 350_000
    assert got[None].loss_sha256 == hashlib.sha256("".join(f"</s> {t}" for t in range(1, 3000, 2)).encode()).hexdigest()
