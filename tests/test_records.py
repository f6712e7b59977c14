"""Rows of delimited text against a reader that goes character by character, and against Spark's own."""

from __future__ import annotations

import csv
import os
import random

import pytest

from mercadia.sources import csv_ingest, records, schemas

CONTROL = {"0": "\0", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a"}


def one_field(text, i, escapes):
    """Value, raw text and end of the field at ``i``; no value where the field does not end as it should."""
    out, at, quoted = "", i, text[i:i + 1] == '"'
    i += quoted
    while True:
        c = text[i:i + 1]
        if not c:
            return (None if quoted else out), text[at:i], i, quoted     # an open quote holds the rest of the file
        if escapes and c == "\\" and i + 1 < len(text):
            if not quoted and text[i + 1] == "\n":
                return None, text[at:i + 1], i + 1, True
            out, i = out + CONTROL.get(text[i + 1], text[i + 1]), i + 2
        elif quoted and c == '"' and text[i + 1:i + 2] == '"':
            out, i = out + '"', i + 2
        elif quoted and c == '"' and text[i + 1:i + 2] in ("", ",", "\n"):
            return out, text[at:i + 1], i + 1, False
        elif not quoted and c in ",\n":
            return out, text[at:i], i, False
        else:
            out, i = out + c, i + 1


def read_slowly(text, escapes):
    """(row text, fields or None) of every row behind the header."""
    rows, i = [], text.index("\n") + 1
    while i < len(text):
        start, found = i, []
        while True:
            value, raw, i, failed = one_field(text, i, escapes)
            if failed:
                found = None
                break
            body = raw[1:-1] if raw.startswith('"') else raw
            found.append(None if escapes and (body == "\\N" or raw == "NULL") else value)
            if text[i:i + 1] != ",":
                break
            i += 1
        row = text[start:i]
        rows.append((row.removesuffix("\n") if i == len(text) and found is None else row, found))
        i += 1
    return [r for r in rows if r[0].strip(" ")]


def split_into(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")


@pytest.fixture()
def splits(spark):
    yield lambda size: split_into(spark, size)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def put(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8", newline="") as fh:
        fh.write(text)
    return path


PIECES = ["a", "b c", '"', '""', ",", ",", '\\"', "\\\\", "\\n", "\\N", "NULL", "\n", '"\n"', "é", '\n"x"y",', "\n1,2\n",
          '"q\nr",z\n', '\n"']


@pytest.mark.parametrize("seed", range(8))
def test_rows_at_any_split(spark, scratch, splits, seed):
    rng = random.Random(seed)
    escapes = seed % 3 != 0
    pieces = [p for p in PIECES if escapes or "\\" not in p]
    text = 'h1,"h2"\n' + "".join(rng.choice(pieces) for _ in range(rng.randrange(10, 50)))
    splits(rng.choice([2, 5, 11, 40]))
    path = put(scratch, "t.csv", text)
    got = records.multi_line_records(spark, path, escapes).orderBy("__pos").collect()
    assert [(r["__record"], r["__values"]) for r in got] == read_slowly(text, escapes)


def reviews(n, seed=0):
    """Well-formed rows: line breaks, doubled quotes and commas in quoted text."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        message = "".join(rng.choice(["good ", "line\n", '"quoted" ', "a, b ", "\n\n", "é", '","']) for _ in range(rng.randrange(0, 9)))
        rows.append([f"r{k}", f"o{k % 50}", str(1 + k % 5), rng.choice(["", "title", 'the "title"']), message,
                     "2017-10-11 00:00:00", ""])
    return rows


def test_one_file_many_tasks_same_rows_as_one_task(spark, scratch, splits):
    path = os.path.join(scratch, "reviews.csv")
    with open(path, "w", encoding="utf-8", newline="") as fh:
        out = csv.writer(fh, lineterminator="\n")
        out.writerows([schemas.RAW_COLUMNS["order_reviews"], *reviews(3000)])
    one_task = (spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
                .option("emptyValue", "").option("nullValue", "\0").csv(path))
    want = [tuple(v or "" for v in r) for r in one_task.collect()]
    splits(4096)
    raw = csv_ingest.read_raw(spark, path, "order_reviews", escapes=False)
    rows = raw.orderBy("__pos").collect()
    assert [tuple(r)[:7] for r in rows] == want and not any(r["__corrupt"] for r in rows)
    assert len({r["__pos"]["split"] for r in rows}) > 40        # the file was read in pieces
    assert [tuple(r)[:7] for r in csv_ingest.read_raw(spark, path, "order_reviews").orderBy("__pos").collect()] == want


def test_source_escapes_in_fields(spark, scratch):
    text = ("review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,"
            "review_answer_timestamp\n"
            'r1,o1,5,"a\\"b","a""b",\\N,\\N\n'
            'r2,o1,4,\\N,"c\\\\","2017-10-11 00:00:00",NULL\n'
            'r3,o1,3,"NULL","x\\ny\\\\n\\,","2017-10-11 00:00:00",""\n'
            'r4,o1,2,in "quotes",a\\,b,,\n'
            'r5,o1,1,"is "literal" here","",,\n'
            "r6,o1,1,too,few\n")
    raw = csv_ingest.read_raw(spark, put(scratch, "r.csv", text), "order_reviews")
    got = {r.review_id: r for r in raw.collect()}
    assert (got["r1"].review_comment_title, got["r1"].review_comment_message) == ('a"b', 'a"b')
    assert got["r1"].review_creation_date is None and got["r2"].review_comment_title is None
    assert got["r2"].review_comment_message == "c\\" and got["r2"].review_answer_timestamp is None
    assert got["r3"].review_comment_title == "NULL" and got["r3"].review_comment_message == "x\ny\\n,"
    assert (got["r4"].review_comment_title, got["r4"].review_comment_message) == ('in "quotes"', "a,b")
    assert got["r5"].review_comment_title == 'is "literal" here' and got["r5"].review_comment_message == ""
    assert got["r6"]["__corrupt"] == "r6,o1,1,too,few" and sum(r["__corrupt"] is not None for r in got.values()) == 1
    typed = {r.review_id: r for r in csv_ingest.typed(raw, "order_reviews").collect()}
    assert typed["r2"].review_answer_timestamp is None and typed["r2"].review_creation_date is not None


def test_null_marks_reach_the_gates(spark, scratch):
    text = ("customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\n"
            "c1,u1,\\N,\"s\\\\o \\\"paulo\\\"\",SP\r\n"
            "\\N,u2,1,x,RJ\n")
    path = put(scratch, "c.csv", text)
    parsed = csv_ingest.parse(csv_ingest.read_raw(spark, path, "customers"), "customers")
    from mercadia.operators.gates import domain_gate
    ok, bad = domain_gate(parsed, csv_ingest.parse_rules("customers", schemas.RAW_COLUMNS["customers"]))
    good = ok.first()
    assert good.customer_zip_code_prefix is None and good.customer_city == 's\\o "paulo"' and good.customer_state == "SP"
    assert [r.reject_reason for r in bad.collect()] == ["customer_id:null"]


def test_long_fields_do_not_recurse(spark, scratch):
    text = "h\n" + '"' + 'x""\\"y\n' * 60_000 + '"\n' + "a" * 500_000 + "\n"
    rows = records.multi_line_records(spark, put(scratch, "l.csv", text))
    got = [r["__values"] for r in rows.orderBy("__pos").collect()]
    assert [len(v) for v in got] == [1, 1] and got[0][0] == 'x""y\n' * 60_000 and len(got[1][0]) == 500_000


def test_files_without_rows(spark, scratch):
    for text in ("", "h1,h2", "h1,h2\n", "h1,h2\n\n\n"):
        path = put(scratch, f"{len(text)}.csv", text)
        assert records.multi_line_records(spark, path).count() == 0 and records.lines(spark, path).count() == 0
