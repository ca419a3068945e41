import random

from kinweave.sources.rejects import CsvColumn, INTEGER, NUMBER, PERSON_COLUMNS, person_records, read_with_rejects, shape_of

COLS = [CsvColumn("id", INTEGER, required=True, arrow="int64"), CsvColumn("name"), CsvColumn("year", NUMBER, low=1600, high=1920, arrow="double")]
SCHEMA = "line_no bigint, c0 string, reason string, extra int"


def parsed(line):
    """The fields of a line, or None if its quoting is broken: one character after the other."""
    out, i = [], 0
    while True:
        if i < len(line) and line[i] == '"':
            j, value = i + 1, ""
            while True:
                if j >= len(line):
                    return None
                if line[j] == '"':
                    if line[j + 1 : j + 2] == '"':
                        value, j = value + '"', j + 2
                        continue
                    break
                value, j = value + line[j], j + 1
            j += 1
            if j < len(line) and line[j] != ",":
                return None
        else:
            j = line.find(",", i)
            j = len(line) if j < 0 else j
            value = line[i:j]
            if '"' in value:
                return None
        out.append(value)
        if j >= len(line):
            return out
        i = j + 1


def expected(line):
    line = line or ""
    line = line[:-1] if line.endswith("\r") else line
    f = parsed(line)
    if f is None:
        return "bad_quoting"
    if len(f) != 3:
        return "too_few_columns" if len(f) < 3 else "too_many_columns"
    v = [None if x.strip(" ") in ("", "NaN") else x.strip(" ") for x in f]
    whole = lambda x: x.removesuffix(".0").isdigit() and x.isascii()
    if v[0] is None or not whole(v[0]):
        return "bad_value"
    if v[2] is not None:
        a, dot, b = v[2].partition(".")
        if not a.isdigit() or dot and not b.isdigit() or not 1600 <= float(v[2]) <= 1920:
            return "bad_value"
    return None


def read(spark, lines):
    df = spark.createDataFrame([(i, x, "clash", 1) for i, x in enumerate(lines)], SCHEMA)
    return {r["line_no"]: r for r in read_with_rejects(df, COLS).collect()}


def test_named_cases(spark):
    lines = [
        "1,a,1800", '2,"a,b",1800', '3,"a\nb",1800\r', '4,"a""b",', '5,a"b,1800', '6,"open,1800', "7,x,1700", '8,"x"y,1800', "", "id,name,year", None, '9,"last', "10,a", "11,a,b,c", "12,a,1800,", "13,a,1599.9",
        "14.0, NaN ,1920.0", "15.5,a,1800", "x,a,1800", ",a,1800", '"16","a","1800"', "17,a\r,1800", "9" * 30 + ",a,1800", "18," + "long " * 200_000 + ",1850", '19,"' + "q" * 300_000,
    ]
    got = read(spark, lines)
    assert {i: r["reason"] for i, r in got.items()} == {i: expected(x) for i, x in enumerate(lines)}
    assert got[2]["name"] == "a\nb" and got[3]["name"] == 'a"b' and got[1]["name"] == "a,b" and got[14 + 2]["id"] == 14 and got[16]["name"] is None
    assert got[22]["reason"] is None and got[22]["id"] is None and got[21]["name"] == "a\r"
    assert got[4]["name"] is None and got[5]["csv_error"] is not None


def test_random_lines_against_one_character_at_a_time(spark):
    r = random.Random(7)
    lines = ["".join(r.choice('1",a\n 8') for _ in range(r.randrange(14))) for _ in range(1500)] + ['1,"x",1800', "2,y,1800"] * 50
    got = read(spark, lines)
    assert {i: x["reason"] for i, x in got.items()} == {i: expected(x) for i, x in enumerate(lines)}
    for i, x in got.items():
        if x["reason"] is None:
            f = parsed(lines[i].removesuffix("\r"))
            name = f[1].strip(" ")
            assert x["name"] == (None if name in ("", "NaN") else name)


def test_shapes_and_empty_table(spark):
    assert shape_of('a,"b,c",d', 3) is None and shape_of("a,b", 3) == "too_few_columns" and shape_of('a,"b', 3) == "bad_quoting"
    assert person_records(spark.createDataFrame([], "line_no bigint, c0 string")).count() == 0
    line = "1,1835,A,A,,B,,1800,Karl,x,G,,1,2,,,,Hjú"
    again = spark.createDataFrame([(1, line), (1, line), (2, line.replace("Karl", "karl")), (3, line.replace("1835", "1836"))], "line_no bigint, c0 string")
    assert sorted((r["line_no"], r["reason"]) for r in person_records(again).fillna("", ["reason"]).collect()) == [(1, ""), (1, ""), (2, "bad_value"), (3, "bad_value")]
    assert len(PERSON_COLUMNS) == 18


def test_stream(spark, tmp_path):
    from kinweave.streaming.records import split_stream

    line = "1,1835,A,A,,B,,1800,Karl,x,G,,1,2,,,,Hjú"
    spark.createDataFrame([(1, line), (2, "x"), (3, line)], "line_no bigint, c0 string").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("line_no bigint, c0 string").parquet(str(tmp_path / "in"))
    split_stream(s, str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 2
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "bad")).select("line_no", "reason").collect()] == [(2, "too_few_columns")]
