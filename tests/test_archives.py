"""ZIP members and headers: layouts, charsets, refusals, and what is read."""

import io
import zipfile

import pytest

from tapeloom.sources import files, readers

HEAD = "datetime,symbol,open,high,low,close,volume,amount"
GBK_HEAD = "代码,时间,收盘,开盘,最高,最低,成交额,成交量"


def archive(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text, charset in members:
            z.writestr(name, text.encode(charset))


def test_members_of_several_layouts_and_archives(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    a = "\r\n".join([HEAD, *[f"2024-01-02 09:{m:02d}:00,sh1,1,2,0.5,{m},10,15" for m in range(30)], "", ""])
    b = "\n".join([GBK_HEAD, '"sz2",2024/1/3 9:31:00,7,1,2,3,20,4', "sz2,bad,1,1,1,1,1,1"])
    archive(tmp_path / "x.zip", [("one.csv", a, "utf-8-sig"), ("empty.csv", "", "utf-8"), ("only.csv", HEAD, "utf-8")])
    archive(tmp_path / "deep" / "y.zip", [("in/two.csv", b, "gbk"), ("in/", "", "utf-8")])
    (tmp_path / "note.txt").write_text("no archive")
    rows = {(r["instrument"], r["dt"].isoformat(), r["minute_of_day"]): (r["close"], r["open"], r["amount"]) for r in readers.read_zip_minute_bars(spark, str(tmp_path)).collect()}
    assert len(rows) == 31
    assert rows["sh1", "2024-01-02", 9 * 60 + 7] == (7.0, 1.0, 15.0)
    assert rows["sz2", "2024-01-03", 9 * 60 + 31] == (7.0, 1.0, 20.0)


def test_member_without_a_required_column_is_refused(spark, tmp_path):
    archive(tmp_path / "x.zip", [("good.csv", HEAD + "\n2024-01-02 09:31:00,sh1,1,1,1,1,1,1", "utf-8"), ("bad.csv", HEAD.replace(",close", "") + "\n2024-01-02 09:31:00,sh2,1,1,1,1,1", "utf-8")])
    with pytest.raises(ValueError, match="missing bar columns.*close"):
        readers.read_zip_minute_bars(spark, str(tmp_path))


def test_later_lines_and_members_win_and_lines_come_in_batches(spark, tmp_path):
    line = "2024-01-02 09:31:00,sh1,1,1,1,{},1,1"
    archive(tmp_path / "x.zip", [("a.csv", "\n".join([HEAD, *[line.format(k) for k in range(50)]]), "utf-8")])
    assert readers.read_zip_minute_bars(spark, str(tmp_path)).collect()[0]["close"] == 49.0
    texts = readers.read_zip_text(spark, str(tmp_path), batch_chars=100)
    assert [r["_o"]["ordinal"] for r in texts[0].orderBy("_o").collect()] == list(range(50))


def test_instrument_from_the_member_name_or_none(spark, tmp_path):
    text = HEAD.replace(",symbol", "") + "\n2024-01-02 09:31:00,1,1,1,1,1,1"
    archive(tmp_path / "x.zip", [("sh7.csv", text, "utf-8")])
    assert readers.read_zip_minute_bars(spark, str(tmp_path)).collect()[0]["instrument"] is None
    assert readers.read_zip_minute_bars(spark, str(tmp_path), r"!(\w+)\.csv$").collect()[0]["instrument"] == "sh7"


def test_no_archive_is_an_error(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(ValueError, match="no file with a header"):
        readers.read_zip_minute_bars(spark, str(tmp_path))


def test_first_line_reads_one_block():
    stream = io.BytesIO(b"a,b\r\n" + b"x" * 1_000_000)
    assert readers._first_line(stream, 1000) == b"a,b" and stream.tell() == 1000
    assert readers._first_line(io.BytesIO(b"h" * 3000 + b"\nrest"), 1000) == b"h" * 3000
    assert readers._first_line(io.BytesIO(b"")) is None
    assert readers._first_line(io.BytesIO(b"only")) == b"only"


def test_headers_of_files_with_spaces_and_without_lines(spark, tmp_path):
    (tmp_path / "a b.csv").write_text(HEAD + "\n2024-01-02,sh1,1,1,1,2,1,1\n", encoding="utf-8")
    (tmp_path / "c%20d.csv").write_bytes((GBK_HEAD + "\nsz2,2024-01-03,5,1,1,1,1,1\n").encode("gbk"))
    (tmp_path / "none.csv").write_text("")
    assert {(r["path"].rsplit("/", 1)[1], r["charset"]) for r in readers.file_headers(spark, [str(tmp_path)]).collect()} == {("a b.csv", "UTF-8"), ("c%20d.csv", "GBK")}
    got = {(r["instrument"], r["close"]) for r in readers.read_bars(spark, [str(tmp_path)]).collect()}
    assert got == {("sh1", 2.0), ("sz2", 5.0)}


@pytest.mark.parametrize("path", ["{}/f.txt", "file:{}/f.txt", "file://{}/f.txt"])
def test_paths_as_spark_writes_them(tmp_path, path):
    (tmp_path / "f.txt").write_bytes(b"abc")
    with files.reader(path.format(tmp_path)) as stream:
        assert stream.read() == b"abc"
