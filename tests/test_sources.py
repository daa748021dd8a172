import csv
from itertools import product

import pytest

from shelfmark.sources.tables import read_csv, write_csv

ODD = ["a", " ", '"', ",", "\n", "\r", "\r\n", "\\", "\t", "\0", "\xa0", "﻿", "#"]
SCHEMA = "n BIGINT, text STRING"


def test_texts_come_back_from_csv_as_they_were(spark, tmp_path):
    texts = [None, ""] + ["".join(p) for k in (1, 2, 3) for p in product(ODD, repeat=k)]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(None, "no number")], SCHEMA)
    write_csv(rows.repartition(3), str(tmp_path / "out"))
    got = {r.n: r.text for r in read_csv(spark, str(tmp_path / "out"), SCHEMA).collect()}
    assert got.pop(None) == "no number"
    assert [(t, got[i]) for i, t in enumerate(texts) if got[i] != t] == []


def test_csv_of_other_writers(spark, tmp_path):
    texts = ["", " a ", '"', 'x "y"\0', "two\nlines\\"]
    for quoting in (csv.QUOTE_MINIMAL, csv.QUOTE_ALL):
        place = tmp_path / f"{quoting}.csv"
        with place.open("w", newline="", encoding="utf-8") as out:
            writer = csv.writer(out, quoting=quoting)
            writer.writerows([("n", "text"), *enumerate(texts), ("", "no number")])
        got = {r.n: r.text for r in read_csv(spark, str(place), SCHEMA).collect()}
        empty = "" if quoting == csv.QUOTE_ALL else None
        assert got == {**dict(enumerate(texts)), 0: empty, None: "no number"}
    for cell in ("x", "1 2", '"1,2"'):
        place = tmp_path / "odd.csv"
        place.write_text(f"n,text\n{cell},a\n")
        with pytest.raises(Exception, match="MALFORMED"):
            read_csv(spark, str(place), SCHEMA).collect()
