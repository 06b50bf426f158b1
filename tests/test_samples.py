"""Each sample file makes exactly its findings."""

import pytest
from samples import SAMPLES

from ledgerlift import cli, copybook
from ledgerlift.errors import LayoutMismatch
from ledgerlift.functions.decoders import Reading
from ledgerlift.operators import extract, profile, rules
from ledgerlift.sources import read_records


def measure(spark, path, layout, page, options, **how):
    records = read_records(spark, str(path), layout.record_length(), **how)
    reading = Reading(page, **options)
    stats = profile.scan(records, layout, reading)
    return stats, rules.evaluate(layout, stats, reading)


@pytest.fixture
def sample(tmp_path):
    def make(name):
        text, page, records, options, codes = SAMPLES[name]
        path = tmp_path / f"{name}.dat"
        path.write_bytes(b"".join(records))
        book = tmp_path / f"{name}.cpy"
        book.write_text(text)
        return path, book, copybook.parse(text), page, options, codes

    return make


@pytest.mark.parametrize("name", SAMPLES)
def test_findings_are_exactly_those_expected(spark, sample, name):
    path, _, layout, page, options, codes = sample(name)
    if codes is LayoutMismatch:
        with pytest.raises(LayoutMismatch) as e:
            measure(spark, path, layout, page, options)
        assert e.value.notes
        return
    _, found = measure(spark, path, layout, page, options)
    assert {f.code for f in found} == codes


def test_wrong_page_shows_as_unknown_sign_bytes(spark, sample):
    path, _, layout, *_ = sample("ascii-native-zoned")
    codes = {f.code for f in measure(spark, path, layout, "cp037", {})[1]}
    assert "UNKNOWN_SIGN_BYTE" in codes and "TRAILING_SIGN" not in codes


@pytest.mark.parametrize("name", ["packed-heavy", "variable-blocked", "unset-numeric"])
def test_partitioning_changes_nothing(spark, sample, name):
    path, _, layout, page, options, _ = sample(name)
    one, _ = measure(spark, path, layout, page, options)
    many, _ = measure(spark, path, layout, page, options, partition_bytes=100)
    assert one == many


def test_limit_takes_the_first_records(spark, sample):
    path, _, layout, page, options, _ = sample("clean")
    stats, _ = measure(spark, path, layout, page, options, limit=7)
    assert {s.examined for s in stats.values()} == {7}


def test_doubling_doubles_totals(spark, sample):
    path, _, layout, page, options, _ = sample("packed-heavy")
    once, _ = measure(spark, path, layout, page, options)
    path.write_bytes(path.read_bytes() * 2)
    twice, _ = measure(spark, path, layout, page, options)
    assert all(twice[k].total == 2 * once[k].total and twice[k].examined == 2 * once[k].examined for k in once)


def test_decode_is_gated_and_can_be_forced(spark, sample, tmp_path):
    path, book, *_ = sample("corrupt-packed")
    out = tmp_path / "out.parquet"
    assert cli.main(["decode", str(book), str(path), "-o", str(out)]) == 2 and not out.exists()
    assert cli.main(["decode", str(book), str(path), "-o", str(out), "--force"]) == 0
    got = spark.read.parquet(str(out))
    assert got.count() == 40 and got.where("`PR-BALANCE` is null").count() == 10
    assert dict(got.dtypes)["PR-LIMIT"] == "decimal(9,2)"


def test_exit_codes(spark, sample, tmp_path):
    path, book, *_ = sample("wrong-copybook")
    assert cli.main(["scan", str(book), str(path)]) == 2
    path, book, *_ = sample("clean")
    assert cli.main(["scan", str(book), str(path)]) == 0
    assert cli.main(["layout", str(book)]) == 0
    assert cli.main(["explain", str(book), str(path)]) == 3
    plan = tmp_path / "plan.json"
    assert cli.main(["plan", str(book), "-o", str(plan)]) == 0
    for form in ("ddl", "jsonschema", "loader", "spark"):
        assert cli.main(["emit", str(plan), "--format", form]) == 0


@pytest.mark.parametrize("data", [b"", b"\0" * 21, b"\xff" * 21, b"\x40" * 21])
def test_edges_do_not_crash(spark, sample, data):
    path, _, layout, page, options, _ = sample("packed-heavy")
    path.write_bytes(data)
    stats, _ = measure(spark, path, layout, page, options, recfm="fixed")
    assert {s.examined for s in stats.values()} == {len(data) // 21}


def test_extract_keeps_repeated_names_apart(spark):
    layout = copybook.parse("01 R.\n 05 A.\n  10 N PIC X.\n 05 B.\n  10 N PIC X.\n 05 FILLER PIC X.")
    df = spark.createDataFrame([(0, bytearray("xyz".encode("cp037")))], "rec_no long, rec binary")
    assert extract.decode(df, layout).columns == ["N@0", "N@1"]
