import random

import duckdb
from pyspark.sql import functions as F

from wayline.llm import queries, quotation

ROWS = [
    (1, 0, "user", "Hello there.\nHow are you?"),
    (1, 1, "assistant", "On Monday, user wrote:\n> Hello there.\n> How are you?\n\nFine, thanks!"),
    (1, 2, "user", "A new matter."),
    (1, 3, "user", "> Fine,   THANKS\n> > how are you\nGlad to hear."),
    (1, 4, "assistant", ">A new matter\nAbout that:\n  and code"),
    (1, 5, "user", "> nobody wrote this\n>\n\nreally"),
    (1, 6, "user", "on the wire he wrote:\nno quote follows"),
    (2, 0, "user", None),
    (2, 1, "user", ""),
    (2, 1, "user", "again"),
    (2, 2, "user", "> again\r\nyes"),
    (3, 5, "user", "Hello there."),
    (3, 4, "user", "> Hello there.\nquoted from later: not linked"),
    (None, 1, "user", "> Hello there."),
    (4, None, "user", "> Hello there.\nx"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def answer(df):
    return sorted(map(tuple, df.collect()), key=str)


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def test_links_and_order(spark):
    got = {(r.conv_id, r.turn, r.text): r for r in quotation.reply_order(frame(spark)).collect()}
    assert len(got) == len(ROWS)
    by = {(c, t): r for (c, t, _), r in got.items()}
    assert by[1, 1].text == "Fine, thanks!" and (by[1, 1].reply_to, by[1, 1].n_linked) == (0, 2)
    assert (by[1, 3].reply_to, by[1, 3].thread, by[1, 3].thread_depth, by[1, 3].max_depth) == (1, 0, 2, 2)
    assert by[1, 4].reply_to == 2 and by[1, 4].text == "About that:\n  and code"
    assert by[1, 5].reply_to is None and by[1, 5].thread == 5
    assert by[1, 6].text.startswith("on the wire")
    assert by[2, 2].reply_to == 1 and by[3, 4].reply_to is None
    assert by[None, 1].reply_to is None and by[4, None].text == "x"


def test_a_long_chain_and_an_empty_table(spark):
    rows = [(7, 0, "u", "line 0")] + [(7, i, "u", f"> line {i - 1}\nline {i}") for i in range(1, 70)]
    got = {r.turn: r for r in quotation.reply_order(frame(spark, rows)).collect()}
    assert all((got[i].thread, got[i].thread_depth) == (0, i) for i in range(70))
    assert quotation.reply_order(frame(spark, [])).count() == 0


def same_as_sql(spark, tmp_path, rows):
    path = str(tmp_path / "conversations.parquet")
    frame(spark, rows).withColumn("reply_to", F.lit("x")).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    cursor = con.execute(queries.ORACLES["op7_quotation"])
    names = [c[0] for c in cursor.description]
    want = sorted(cursor.fetchall(), key=str)
    got = queries.op7_quotation(spark, str(tmp_path))
    assert got.columns == names and answer(got) == want
    return want


def test_sql_agrees(spark, tmp_path):
    same_as_sql(spark, tmp_path, [r for r in ROWS if r[0] is not None and r[1] is not None])


def test_sql_agrees_on_thousands_of_quoting_messages(spark, tmp_path):
    rng, rows = random.Random(11), []
    for conv in range(250):
        said: list[list[str]] = []
        for turn in range(20):
            own = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(40))]
            text = []
            for _ in range(rng.choice((0, 1, 1, 2))):
                if not said:
                    continue
                words = rng.choice(said)
                a = rng.randrange(len(words) + 1)
                part, depth, width = words[a : a + rng.randrange(1, 25)], rng.choice((1, 1, 2, 3)), rng.randrange(2, 12)
                if rng.random() < 0.3:  # a quote with a word of its own
                    part = part[: len(part) // 2] + ["new"] + part[len(part) // 2 :]
                text += [rng.choice(("> ", ">")) * depth + " ".join(part[i : i + width]).upper() for i in range(0, len(part), width)]
                text.append("" if rng.random() < 0.5 else f"w{rng.randrange(30)}")
            width = rng.randrange(3, 15)
            text += [" ".join(own[i : i + width]) for i in range(0, len(own), width)]
            said.append(own)
            rows += [(conv, turn, "u", "\n".join(text))] * (2 if rng.random() < 0.02 else 1)
    want = same_as_sql(spark, tmp_path, rows)
    assert sum(r[7] is not None for r in want) > 1000


def test_a_megabyte_in_one_message(spark):
    long = [" ".join(f"w{(i * 10 + j) % 7919}x{i % 13}" for j in range(10)) for i in range(14_000)]
    quote = "\n".join("> " + x for x in long) + "\nyes"
    got = {r.turn: r for r in quotation.reply_order(frame(spark, [(1, 0, "u", "\n".join(long)), (1, 1, "u", quote)])).collect()}
    assert len(quote) > 1_000_000
    assert (got[1].reply_to, got[1].n_linked, got[1].text) == (0, len(long), "yes")


def test_rewrapped_and_partial_quotes(spark):
    rows = [
        (1, 0, "u", "yes"),
        (1, 1, "u", "The plan that we made last week\nneeds two more people and a van.\nyes\nWe leave at noon, then."),
        (1, 2, "u", "> The plan that we made\n> last week needs two more\n> people and a van.\n> yes\nFine."),
        (1, 3, "u", "> more people and a van. Yes\nWhich van?"),
        (1, 4, "u", ">> last week needs two\n>> more people\n> Which\n> van?\nThe red one."),
        (1, 5, "u", "> people with two other needs, a van\nnobody wrote that"),
        (1, 6, "u", "> Yes\nto what?"),
        (2, 7, "u", "> last week needs two more people\nanother conversation"),
    ]
    got = {r.turn: r for r in quotation.reply_order(frame(spark, rows)).collect()}
    assert {t: r.reply_to for t, r in got.items()} == {0: None, 1: None, 2: 1, 3: 1, 4: 3, 5: None, 6: 0, 7: None}
    assert {t: r.n_linked for t, r in got.items()} == {0: 0, 1: 0, 2: 4, 3: 1, 4: 4, 5: 0, 6: 1, 7: 0}
    assert (got[4].thread, got[4].thread_depth) == (1, 2)


def test_only_native_operators(spark):
    plan = quotation.reply_order(frame(spark))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
