"""Splitting of packed values: cases by hand, and a row-by-row reader as brute force for quoted lists."""

import csv
import random

import pyarrow as pa
import pytest

from citeloom.operators.split_values import split_array, split_values

CASES = {
    "A. Bell, C Dow and E. F. Gray": ["A. Bell", "C Dow", "E. F. Gray"],
    "A. Bell, C Dow, and E. Gray": ["A. Bell", "C Dow", "E. Gray"],
    "A Bell; Dow, C.; Gray, Eva; H Ito": ["A Bell", "Dow, C.", "Gray, Eva", "H Ito"],
    "A Bell , C Dow; Eva Gray,H Ito": ["A Bell", "C Dow", "Eva Gray", "H Ito"],
    "Eva Gray, PhD, H Ito": ["Eva Gray, PhD", "H Ito"],
    "MD Bell, H Ito": ["MD Bell", "H Ito"],
    "Dr. Eva Gray | H Ito": ["Dr. Eva Gray", "H Ito"],
    "A Bell / C Dow": ["A Bell", "C Dow"],
    "A Bell\tC Dow\tEva Gray": ["A Bell", "C Dow", "Eva Gray"],
    "A Bell\nC Dow\nEva Gray, PhD": ["A Bell", "C Dow", "Eva Gray, PhD"],
    "A Bell • C Dow • Eva Gray": ["A Bell", "C Dow", "Eva Gray"],
    "A Bell · C Dow": ["A Bell", "C Dow"],
    '"A Bell", "Dow, C."': ["A Bell", "Dow, C."],
    'A Bell,"Eva ""Evi"" Gray",H Ito': ["A Bell", 'Eva "Evi" Gray', "H Ito"],
    'A Bell, Eva "Evi" Gray': ["A Bell", 'Eva "Evi" Gray'],
    "'A Bell', 'Dow, C.'": ["A Bell", "Dow, C."],
    "['A Bell', 'C Dow']": ["A Bell", "C Dow"],
    "A O'Hara, C Dow": ["A O'Hara", "C Dow"],
    "Lumen, Lattice and Light Initiative; A Bell": ["Lumen, Lattice and Light Initiative", "A Bell"],
    "A Bell, C Dow, et al.": ["A Bell", "C Dow"],
    "A Bell et al.": ["A Bell"],
    "A Bell; Eva Gray, PhD et al.": ["A Bell", "Eva Gray, PhD"],
    "A Bell; Gray, E. et al.": ["A Bell", "Gray, E."],
    "A Bell; Cell and Module Consortium et al.": ["A Bell", "Cell and Module Consortium"],
    "A Bell, C Dow, ...": ["A Bell", "C Dow"],
    "A Bell, and others": ["A Bell"],
    ", A Bell,, C Dow, ": ["A Bell", "C Dow"],
    " A Bell ​": ["A Bell"],
    "": [],
    "   ": [],
    "NA": [],
    "couldnt find": [],
    "et al.": [],
    '"A Bell, C Dow': ['"A Bell', "C Dow"],
}


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert split_array(pa.array([text])).to_pylist() == [CASES[text]]


def test_rows_do_not_touch_each_other():
    texts = [*CASES, None, *reversed(CASES)]
    got = split_array(pa.array(texts)).to_pylist()
    assert got == [CASES.get(t, []) for t in texts]
    assert split_array(pa.array(texts).slice(3, 9)).to_pylist() == got[3:12]
    assert split_array(pa.array([], pa.string())).to_pylist() == []


def test_quoted_lists_against_csv_reader():
    rnd = random.Random(1)
    names = ["A Bell", "Dow, C.", 'Eva "Evi" Gray', "Ж. Иванов", "李 明", "O'Hara B"]
    rows = [[rnd.choice(names) for _ in range(rnd.randint(1, 9))] for _ in range(300)]
    texts = [",".join('"' + n.replace('"', '""') + '"' for n in r) for r in rows]
    assert split_array(pa.array(texts)).to_pylist() == [next(csv.reader([t])) for t in texts] == rows


def test_frame(spark):
    long = ", ".join(f"A{i} Bell" for i in range(20_000))
    df = spark.createDataFrame([(1, "A Bell, C Dow", "x"), (1, "A Bell, C Dow", "x"), (2, None, "y"), (3, long, None)], "id long, authors string, author_extra string")
    out = split_values(df, "authors", ["id"], "author").collect()
    assert sorted((r.id, r.item_no, r.author) for r in out if r.id == 1) == [(1, 1, "A Bell"), (1, 1, "A Bell"), (1, 2, "C Dow"), (1, 2, "C Dow")]
    assert sum(r.id == 3 for r in out) == 20_000 and not any(r.id == 2 for r in out)
    assert split_values(df.limit(0), "authors", ["id"], "author").count() == 0
    with pytest.raises(ValueError):
        split_values(df, "authors", ["id"], "id")
