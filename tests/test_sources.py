import pytest

from ledgerlift import cli, copybook
from ledgerlift.errors import LayoutMismatch, VariableRecordError
from ledgerlift.sources import detect_recfm, divisors, head_note, mismatch_notes, partial_view_note, read_records
from ledgerlift.streaming import stream_decoded


def vb(bodies, reserved=b"\0\0"):
    return b"".join((len(b) + 4).to_bytes(2, "big") + reserved + b for b in bodies)


@pytest.fixture
def file(tmp_path):
    def write(data):
        path = tmp_path / "data.bin"
        path.write_bytes(data)
        return str(path)

    return write


def body(df):
    return [bytes(r["rec"]) for r in df.orderBy("rec_no").collect()]


def test_fixed_records_in_file_order(spark, file):
    recs = [f"{i:06d}".encode() for i in range(500)]
    path = file(b"".join(recs))
    assert body(read_records(spark, path, 6, partition_bytes=60)) == recs
    assert body(read_records(spark, path, 6, limit=17, partition_bytes=60)) == recs[:17]


def test_variable_records(spark, file):
    recs = [b"x" * (i % 9) for i in range(400)]
    path = file(vb(recs) + vb([b"abc"]))
    assert detect_recfm(path, 1013) == "vb"
    assert body(read_records(spark, path, 1013, partition_bytes=100)) == [*recs, b"abc"]
    assert len(body(read_records(spark, path, 1013, limit=5))) == 5
    assert detect_recfm(file(vb(recs, b"\1\2")), 1013) == "vb"


def test_broken_chains(spark, file):
    with pytest.raises(VariableRecordError, match="descriptor"):
        read_records(spark, file(b"\0\2\0\0abc"), 3, recfm="vb")
    with pytest.raises(VariableRecordError, match="left"):
        read_records(spark, file(b"\0\x20\0\0abc"), 3, recfm="vb")
    with pytest.raises(LayoutMismatch):
        read_records(spark, file(vb([b"ab"]) + b"\0"), 3, recfm="vb")


def test_the_command_line_refuses_without_a_traceback(spark, file, tmp_path, capsys):
    book = tmp_path / "r.cpy"
    book.write_text("       01 R.\n           05 T PIC X(3).\n")
    broken = file(b"\0\x20\0\0abc")
    for args in (["scan", str(book), broken, "--recfm", "vb"], ["scan", str(book), str(tmp_path / "none")], ["scan", str(tmp_path / "none.cpy"), broken], ["scan", str(book), file(b"abc"), "--encoding", "cp9999"]):
        assert cli.main(args) == 2 and capsys.readouterr().err.strip()


def test_a_chain_of_any_length_is_detected(file):
    import numpy as np

    one = np.frombuffer(vb([b"x"]), np.uint8)
    assert detect_recfm(file(np.tile(one, 5_000_003).tobytes()), 7) == "vb"


def test_refusal_and_leads(spark, file):
    path = file(b"a" * 77 * 3)
    with pytest.raises(LayoutMismatch) as e:
        read_records(spark, path, 73)
    assert any("73 + 4" in n for n in e.value.notes) and any("77" in n for n in e.value.notes)
    assert any("no likely length" in n for n in mismatch_notes(7919, 50))
    assert divisors(12) == [2, 3, 4, 6, 12] and divisors(1) == []
    assert "descriptor" in head_note(path) and "only 2" in head_note(file(b"ab"))


def test_partial_view():
    layout = copybook.parse("01 A REDEFINES ELSEWHERE.\n 05 B PIC X(5).")
    assert "--record-bytes" in partial_view_note(layout)
    assert partial_view_note(copybook.parse("01 A.\n 05 B PIC X.")) is None


def test_empty_file(spark, file):
    assert body(read_records(spark, file(b""), 5, recfm="fixed")) == []


def test_hadoop_paths(spark, file):
    path = file(b"abcdef")
    assert body(read_records(spark, f"file://{path}", 3)) == [b"abc", b"def"]


def test_stream(spark, tmp_path):
    layout = copybook.parse("01 R.\n 05 K PIC 9(3).\n 05 T PIC X(2).")
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a").write_bytes("001ab002cd".encode("cp037"))
    (folder / "b").write_bytes("003ef".encode("cp037"))
    query = stream_decoded(spark, str(folder), layout).writeStream.format("memory").queryName("streamed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    assert sorted((r["K"], r["T"]) for r in spark.table("streamed").collect()) == [(1, "ab"), (2, "cd"), (3, "ef")]
