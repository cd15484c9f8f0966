import random

from pyspark.sql import functions as F

from quernstone.functions import chunks, cites


def test_blocks_cover_the_text_within_their_size():
    rng = random.Random(1)
    for _ in range(60):
        lines = [("//STEP EXEC " if rng.random() < 0.2 else "") + " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(0, 120))) for _ in range(rng.randrange(1, 25))]
        text = "\n".join(lines)
        made = chunks.blocks(text, 500, 80)
        held = set()
        for s, e in made:
            held.update(range(s, e))
            inside = [u for u in chunks.units(text) if u[0] < e and u[1] > s]
            assert e - s <= 500 or (len(inside) == 1 and inside[0][2])
        assert all(i in held for i, c in enumerate(text) if not c.isspace())
        for s, e, atomic in chunks.units(text):
            if atomic:
                assert any(a <= s and e <= b for a, b in made)
    assert chunks.blocks("") == [] and chunks.blocks(" \n ") == []


def test_expansion_references_and_fitting():
    glossary = {"IPL": "Initial Program Load", "LE": "Language Environment", "CF": "Coupling Facility"}
    assert cites.expanded("what is ipl in le or cf, IPL", glossary) == "what is ipl in le or cf, IPL ipl (Initial Program Load) cf (Coupling Facility)"
    assert cites.decode_reference(cites.encode_reference("b", "c", "d")) == ("b", "c", "d")
    short, gone = cites.fitted("x" * 1000, 100, len)
    assert len(short) <= 100 and gone == 1000 - (len(short) - 3)


def test_lines_of_white_space_count_for_nothing(spark):
    """White space of any kind is blank, and any line end ends a line, here and in the SQL."""
    import duckdb

    from quernstone.functions import text as T

    cases = {
        "a  b\n\t\n\t\nx  y": "table", "\t\n" * 6 + "IEA100I msg": "message", "\u00a0\n\u2003\r\n\x1c\n" * 3 + "\u3000 IEA100I msg": "message",
        "one\rtwo\u2028three\x85four\x0bfive\x0csix\nIEA100I": "narrative", "a  b\x0ba  b\u2029a  b\x1cplain": "table", "": "narrative", "\u2028 \t": "narrative",
    }
    docs = spark.createDataFrame(list(cases.items()), "text string, want string")
    assert all(r.got == r.want for r in docs.select("want", T.chunk_type(F.col("text")).alias("got")).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id INT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(cases)))
    assert dict(con.execute(T.CHUNK_TYPE_SQL).fetchall()) == dict(enumerate(cases.values()))
