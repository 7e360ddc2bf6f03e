"""Sources, schema mapping, cleaning, validation."""

import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from feedloom.functions.dates import parse_timestamp, week_ending
from feedloom.functions.numbers import parse_number
from feedloom.functions.text import MAY_CHANGE, clean_text, nonblank, request_text
from feedloom.operators import distinct
from feedloom.operators.cleaning import cleaning_warnings
from feedloom.operators.conform import conform, number_rows, suggest_mapping
from feedloom.operators.quality import mixed_type_profile, quality_summary, validate
from feedloom.plans import ingest
from feedloom.sources.csv import describe_files, file_warnings, read_feedback_csv
from feedloom.sources.sinks import write_csv, write_json
from feedloom.sources.tables import file_fingerprints, new_files

ROWS = [
    (0, "A-1", "  Lovely   soup!  ", "2025-01-01", "5", "iOS"),
    (1, None, "<i>Slow</i> courier https://example.com/x", "bad-date", "2", "Android"),
    (2, "A-3", "   ", "2025-01-03", "3", "iOS"),
    (3, "A-4", "Card refused", "2025-01-04", "bad", " Android "),
    (4, "A-5", "Refund pending", "2025-01-05", "8", ""),
    (5, "A-1", "  Lovely   soup!  ", "2025-01-01", "5", "iOS"),
]


@pytest.fixture
def source(spark):
    return spark.createDataFrame(ROWS, "pos long, id string, content string, created_at string, score string, source string")


def test_cleaning_counts_and_values(source):
    result = ingest(source.repartition(3), order_by="pos")
    rows = {r["source_row_number"]: r for r in result.dataframe.collect()}
    assert sorted(rows) == [2, 3, 5, 6]
    assert rows[2]["original_text"] == "  Lovely   soup!  " and rows[2]["clean_text"] == "Lovely soup!"
    assert rows[3]["review_id"] == "IF-0000003" and rows[3]["clean_text"] == "Slow courier" and rows[3]["date"] is None
    assert rows[5]["rating"] is None and rows[5]["platform"] == "Android"
    assert rows[6]["rating"] is None and rows[6]["platform"] is None and rows[6]["device"] is None
    report = result.report.first()
    assert tuple(report) == (6, 4, 1, 1, 1, 1, 2)
    assert len(cleaning_warnings(report)) == 4


def test_validation_messages(source):
    result = validate(source.drop("pos"), max_rows=5)
    assert not result.can_proceed and "limit of 5" in result.errors[0]
    assert result.counts["duplicate_row_count"] == 1 and result.counts["invalid_rating_count"] == 1
    assert result.counts["out_of_range_rating_count"] == 1 and result.counts["invalid_date_count"] == 1
    assert result.missing_optional_fields == ["app_version", "country", "device", "user_segment"]
    assert "score" in result.mixed_type_columns
    profile = {r["column_name"]: r for r in mixed_type_profile(source).collect()}
    assert profile["created_at"]["date_values"] == 5 and profile["created_at"]["is_mixed"]


def test_mapping_by_alias_and_errors(source):
    assert suggest_mapping(["Content", "score", "AT", "source", "id"])["date"] == "AT"
    assert suggest_mapping(["region", "city"])["country"] == "region"
    with pytest.raises(ValueError, match="several fields"):
        conform(source, {"review_text": "content", "rating": "content"})
    with pytest.raises(ValueError, match="review_text"):
        conform(source, {"rating": "score"})


@pytest.mark.parametrize("kind", ["long", "string", "date", "timestamp", "timestamp_ntz", "double"])
def test_row_numbers_follow_any_key(spark, kind):
    key = {"long": F.col("id"), "string": F.format_string("%06d", "id"), "date": F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")),
           "double": F.col("id") / 8}.get(kind, F.timestamp_seconds("id").cast(kind))
    rows = spark.range(500).withColumn("id", F.col("id") * 7).select("id", key.alias("key")).repartition(7)
    got = number_rows(rows, "key").orderBy("id").select("source_row_number").collect()
    assert [r[0] for r in got] == list(range(2, 502))


def test_text_helpers(spark):
    nbsp = " "
    df = spark.createDataFrame([(f"{nbsp} ﬁne  café{nbsp}x ", nbsp + " \t"), ("ＡＢＣ www.x.org", None)], "a string, b string")
    rows = df.select(clean_text(F.col("a")).alias("a"), nonblank(F.col("b")).alias("b")).collect()
    assert [r["a"] for r in rows] == ["fine café x", "ABC"] and [r["b"] for r in rows] == [False, False]
    spellings = spark.createDataFrame([("MULTI-CURRENCY",), ("multicurrency",), ("Multi Currency!",)], "t string")
    assert {r[0] for r in spellings.select(request_text(F.col("t"))).collect()} == {"multi currency"}


def test_unmarked_characters_are_their_own_normal_form():
    kept = [chr(c) for c in range(0x3000) if not re.search(re.sub(r"\\x\{(\w+)\}", lambda m: "\\u" + m[1].zfill(4), MAY_CHANGE), chr(c))]
    text = "".join(kept)
    assert len(kept) > 180 and unicodedata.normalize("NFKC", text) == text


@pytest.mark.parametrize(("text", "value"), [("4", 4.0), (" 4.5 ", 4.5), ("4d", None), ("NaN", None), ("", None), ("1e0", 1.0)])
def test_numbers(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(parse_number(F.col("t"))).first()[0] == value


@pytest.mark.parametrize(("text", "day"), [
    ("2025-01-02", "2025-01-02"), ("01/02/2025", "2025-01-02"), ("31/12/2025", "2025-12-31"), ("Jan 5, 2025", "2025-01-05"),
    ("20250102", "2025-01-02"), ("2025", "2025-01-01"), ("12:30", None), ("not-a-date", None), ("2026-99-40", None),
    ("31/31/2026", None), ("2025-01-02 10:11:12", "2025-01-02"),
])
def test_dates(spark, text, day):
    value = spark.createDataFrame([(text,)], "t string").select(parse_timestamp(F.col("t")).cast("date").cast("string")).first()[0]
    assert value == day


def test_weeks_end_on_monday(spark):
    df = spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-01-08')) AS d").select("d", week_ending(F.col("d")).alias("w"))
    weeks = {str(r["d"]): str(r["w"]) for r in df.collect()}
    assert weeks["2024-01-01"] == "2024-01-01" and weeks["2024-01-02"] == "2024-01-08" == weeks["2024-01-08"]


def test_csv_scan(spark, tmp_path):
    good = tmp_path / "a.csv"
    good.write_text('id,content,score\nR1,"line one\nline two",5\nR2,NA,4\nR3,short\n', encoding="utf-8-sig")
    latin = tmp_path / "b.csv"
    latin.write_bytes("id,content,score\nR4,café,3\n".encode("latin-1"))
    rows = {r["id"]: r for r in read_feedback_csv(spark, [str(good), str(latin)]).collect()}
    assert rows["R1"]["content"] == "line one\nline two" and rows["R2"]["content"] is None
    assert rows["R3"]["score"] is None and rows["R4"]["content"] == "café"
    assert sorted(r["source_row_number"] for r in rows.values()) == [2, 3, 4, 5]
    assert len(file_warnings(describe_files(spark, [str(good), str(latin)]))) == 1
    for name, line in (("c", "R1,x,extra"), ("g", "R1,x,,extra"), ("h", 'R1,"x, y",z'), ("i", "R1,x,")):
        long = tmp_path / f"{name}.csv"
        long.write_text(f"id,content\nR0,fine\n{line}\n")
        with pytest.raises(Exception, match="more fields"):
            read_feedback_csv(spark, str(long)).collect()
    empty, header = tmp_path / "d.csv", tmp_path / "e.csv"
    empty.write_text("")
    header.write_text("id,content\n")
    for path, message in ((empty, "empty"), (header, "no rows"), (tmp_path / "f.txt", "end in .csv")):
        with pytest.raises(ValueError, match=message):
            read_feedback_csv(spark, str(path))
    with pytest.raises(ValueError, match="limit of 2"):
        read_feedback_csv(spark, str(good), max_rows=2)


def test_csv_headers_are_aligned_by_name(spark, tmp_path):
    for name, text in (("a", "id,content\nR1,one\n"), ("b", 'content,id\n"two, with comma",R2\nshort\n'), ("c", "id,other\nR3,x\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    rows = read_feedback_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()
    assert {(r["id"], r["content"]) for r in rows} == {("R1", "one"), ("R2", "two, with comma"), (None, "short")}
    assert sorted(r["source_row_number"] for r in rows) == [2, 3, 4]
    with pytest.raises(ValueError, match="other columns"):
        read_feedback_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "c.csv")])


def test_fingerprints_of_large_files(spark, tmp_path):
    folder = tmp_path / "in put"
    folder.mkdir()
    contents = {"a.bin": b"x" * 5000, "b b.bin": bytes(range(256)) * 70_000, "ü%20.bin": b"\0" * 9_000_000, "empty.bin": b"", "edge.bin": b"y" * 4096, "skipped.txt": b"z"}
    for name, content in contents.items():
        (folder / name).write_bytes(content)
    expected = {hashlib.sha256(n.encode() + b"\0" + c).hexdigest() for n, c in contents.items() if c and n.endswith(".bin")}
    limit = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    try:
        for beyond, most in ((4096, 4096), (0, 0), (64 << 20, int(limit))):
            # The content of a file beyond this length would raise an error.
            spark.conf.set("spark.sql.sources.binaryFile.maxLength", str(most))
            rows = file_fingerprints(spark, str(folder), "*.bin", whole_up_to=beyond).collect()
            assert len(rows) == 4 and {r["fingerprint"] for r in rows} == expected
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", limit)


def test_manifest_and_sinks(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("x\n1\n")
    seen = file_fingerprints(spark, str(folder))
    manifest = spark.createDataFrame(seen.collect(), seen.schema)
    (folder / "b.csv").write_text("x\n1\n")
    found = new_files(file_fingerprints(spark, str(folder)), manifest).collect()
    assert [r["path"].endswith("b.csv") for r in found] == [True]
    df = spark.createDataFrame([(float("nan"), None, "é")], "b double, a string, c string")
    write_json(df, str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).first()[0] == '{"a":null,"b":null,"c":"é"}'
    write_csv(df.withColumn("theme", F.lit("T")), str(tmp_path / "csv"), partition_by=["theme"])
    assert (tmp_path / "csv" / "theme=T").exists()
    assert quality_summary(None, spark).first()["notes"] == ["Cleaning report was not supplied."]


def test_csv_with_line_breaks_in_quotes_is_split(spark, tmp_path):
    """Records of many lines, over many splits, equal what Python's reader gives; more than one task reads a file."""
    import csv as reader

    from feedloom.sources import records

    body = ["id,review_text,rating"]
    for i in range(400):
        text = ["plain", 'say ""hi""', "two\nlines", "a\n\nb,c\nd", '""', "x" * 90][i % 6]
        body.append(f'{i},"{text}",{i % 5 + 1}')
        if i % 50 == 0:
            body.append("")
    for name, end in (("unix", "\n"), ("dos", "\r\n")):
        (tmp_path / f"{name}.csv").write_bytes((end.join(body) + end).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for name in ("unix", "dos"):
            path = str(tmp_path / f"{name}.csv")
            assert records.lines_of(spark, [path], "UTF-8").rdd.getNumPartitions() > 5
            rows = read_feedback_csv(spark, path, na_tokens=()).orderBy("source_row_number").collect()
            want = [r for r in reader.reader("\n".join(body).splitlines(keepends=True)) if r][1:]
            assert [[r["id"], r["review_text"] or "", r["rating"]] for r in rows] == want
            assert [r["source_row_number"] for r in rows] == list(range(2, 402))
    finally:
        for key, value in zip(("maxPartitionBytes", "openCostInBytes"), before, strict=True):
            spark.conf.set(f"spark.sql.files.{key}", value)
    latin = tmp_path / "latin.csv"
    latin.write_bytes('id,review_text\n1,"caf\xe9\nbar"\n2,"a,b"\n'.encode("latin-1"))
    assert [tuple(r) for r in read_feedback_csv(spark, str(latin), row_numbers=False).orderBy("id").collect()] == [("1", "caf\xe9\nbar"), ("2", "a,b")]
    long = tmp_path / "long.csv"
    long.write_text('id,review_text\n1,"a\nb",extra\n')
    with pytest.raises(Exception, match="more fields"):
        read_feedback_csv(spark, str(long)).collect()


def _copies(rows):
    """Content -> (smallest row number, copies)."""
    out = {}
    for *content, number in rows:
        first, n = out.get(tuple(content), (number, 0))
        out[tuple(content)] = min(first, number), n + 1
    return out


@pytest.mark.parametrize("prints", ["own", "all equal", "two values"])
def test_distinct_rows_with_any_fingerprint(spark, prints):
    """Content decides, however many rows share a fingerprint; nulls are values and their place counts."""
    made = {
        "own": distinct.fingerprints, "all equal": lambda columns: (F.lit(0).cast("long"), F.lit(0).cast("long")),
        "two values": lambda columns: (F.xxhash64(*columns) % 2, F.lit(0).cast("long")),
    }[prints]
    rows = [("a", None, 5), (None, "a", 6), ("a", None, 3), (None, None, 8), (None, None, 7), ("b", "c", 1), ("", None, 2), *[("hot", "row", 100 + i) for i in range(300)]]
    df = spark.createDataFrame(rows, "x string, y string, n long").repartition(6)
    got = {(r["x"], r["y"]): (r["n"], r["copies"]) for r in distinct.distinct_rows(df, "n", "copies", made).collect()}
    assert got == _copies(rows)
    assert distinct.surplus_rows(df, ["x", "y"], prints=made).first()["surplus"] == len(rows) - len(got)
    by_x = {r["x"]: r["d"] for r in distinct.distinct_counts(df, "y", ["x"], "d").collect()}
    assert by_x == {"a": 0, None: 1, "b": 1, "": 0, "hot": 1}
    assert distinct.distinct_counts(df, "y", name="d").first()["d"] == 3
    nothing = df.limit(0)
    assert distinct.distinct_rows(nothing, "n", "copies", made).collect() == [] and distinct.distinct_counts(nothing, "y", name="d").first()["d"] == 0


def test_only_repeated_rows_are_shuffled_whole(spark):
    """Rows that are alone with their fingerprint reach the result by a broadcast join and no exchange."""
    df = spark.createDataFrame([(f"text {i}", i) for i in range(500)], "x string, n long")
    single, suspect = distinct.split_repeated(df, ["x"])
    assert single.count() == 500 and suspect.count() == 0
    plan = single._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_sketches_merge_like_sets(spark):
    rows = [(f"2024-01-{d:02d}", "ab"[i % 2], f"t{(i * 7 + d) % 4000}") for d in range(1, 11) for i in range(3000)]
    df = spark.createDataFrame(rows, "date string, k string, t string")
    sketches = distinct.value_sketches(df, "t", ["k"])
    assert sketches.count() == 20
    exact = {r["k"]: r["d"] for r in distinct.distinct_counts(df, "t", ["k"], "d").collect()}
    for r in distinct.estimated_distinct(sketches, ["k"]).collect():
        assert r["rows"] == 15000 and abs(r["estimate"] - exact[r["k"]]) <= distinct.SKETCH_ERROR * exact[r["k"]]
