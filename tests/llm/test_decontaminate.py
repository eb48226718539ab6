import random

import duckdb
import pytest

from strandlake.llm import decontaminate, queries

FILL = "here are some quite plain words that say nothing of note at all and go on"


def found(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(i + 1, t) for i, t in enumerate(items)], "item_id long, text string")
    rows = decontaminate.contaminated(docs, bench).collect()
    return {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in rows}


def test_short_items_at_every_place(spark):
    items = ["does the old grey cat like warm milk", "Which large river flows through central Paris today", "Why so late?", "Compute 3 + 4 * 5 - 6", "11 12 13 14"]
    words = FILL.split()
    texts = [" ".join([*words[:k], items[0], *words[k:]]) for k in range(8)] + [f"they ask {items[1]} again", "We met. Why so late? No.", "why so late was it", "now compute 7 + 8 * 9 - 5 then", "compute 7 and 8", "see 11 12 13 14 there", "see 21 22 23 24 there"]
    got = found(spark, texts, items)
    assert got == {**{(k, 1): False for k in range(8)}, (8, 2): False, (9, 3): False, (11, 4): True, (13, 5): False}


def test_first_word_inside_a_sentence_must_be_equal(spark):
    got = found(spark, ["he knows that What is the capital of France", "he knows that Paris is the capital of France"], ["What is the capital of France?"])
    assert got == {(0, 1): False}


def test_each_occurrence_is_judged(spark):
    item = "a train runs 60 km in 2 hours"
    a, b = item.replace("60", "80"), item.replace("60", "90")
    got = found(spark, [f"{a}. {FILL}. {b}", f"{item}. {FILL}. {b}", item.replace("2", "60")], [item])
    assert got == {(0, 1): True, (1, 1): True}


def test_each_list_of_values_is_tried(spark):
    items = ["take 2 pears and add 2 plums now", "take 3 pears and add 5 plums now"]
    got = found(spark, [items[1], items[0], items[1].replace("3", "7")], items)
    assert got == {(0, 1): False, (1, 1): False, (2, 1): True}


def test_names_at_sentence_starts_and_number_words(spark):
    items = ["John has 5 apples. Mary has 3 pears. Tom takes 4 plums.", "Anna has 5 apples and buys 3 more", "a box holds three red balls and seven blue ones in it", "take 2 pears and give them to Ruth"]
    texts = ["Kate has 6 apples. Lucy has 2 pears. Bob takes 9 plums.", "Kate has 7 apples and buys 2 more", "a box holds four red balls and nine blue ones in it", "Now take 3 pears and give them to Carl", "Take 3 pears and give them to Carl"]
    texts += items + ["Kate has 6 apples. Lucy has 2 pears. Kate takes 9 plums.", "John has 6 apples. Lucy ate 2 pears. Bob sold 9 plums.", "We like apples and pears. They like plums."]
    got = found(spark, texts, items)
    want = {(0, 1): True, (1, 2): True, (2, 3): True, (3, 4): True, (4, 4): True, (5, 1): False, (6, 2): False, (7, 3): False, (8, 4): False}
    assert {k: v for k, v in got.items() if k[0] != 9} == want


def test_plain_prose_is_left_alone(spark):
    rng = random.Random(6)
    pool = "The What She Find a cat river house runs holds slowly over under and with seven two red old of it has".split()
    prose = [". ".join(" ".join(rng.choices(pool, k=rng.randrange(4, 12))) for _ in range(20)) for _ in range(60)]
    items = ["Anna has 5 apples and buys 3 more", "What is the capital of France?", "The cat of John runs over the old red house", "a box holds three red balls and seven blue ones in it"]
    assert found(spark, prose, items) == {}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_sql_on_random_texts(spark, tmp_path, seed):
    rng = random.Random(seed)
    pool = ["the", "cat", "Paris", "Oslo", "3", "4", "2.5", "three", "Seven", "The", "Take", "take", "km", "m", "runs", ".", "?", "\n", "Éa", "ß", "Km", "x1"]
    line = lambda n: " ".join(rng.choices(pool, k=n))
    items = [line(rng.choice([1, 2, 3, 3, 4, 5, 8, 9, 12])) for _ in range(40)] + ["3 4 3 4", "4 3 4 3", "", None, "the cat runs 3 km in Paris", "the cat runs 4 km in Oslo"]
    texts = [line(rng.choice([1, 3, 8, 20, 60])) for _ in range(60)] + [None, "", ".", "the cat runs 4 km in Paris"]
    for t in items[:40]:
        texts += [t, f"{line(5)} {t} {line(5)}", f"Now. {t.replace('3', '7').replace('Oslo', 'Rome')}. {t}"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[-1]), (None, texts[-2]), (5, texts[-3])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = db.execute(queries.ORACLE_SQL["op9_decontamination"]).fetchall()
    got = queries.op9_decontamination(spark, str(tmp_path)).select("doc_id", "item_id", "n_windows", "reparameterised").collect()
    assert want and any(r[3] for r in want)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
