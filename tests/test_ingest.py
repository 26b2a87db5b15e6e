import io
import os
import tempfile
import zipfile

from tabsense.sources import readers as S
from tabsense.streaming.ingest import ingest_folder


def _folder():
    return tempfile.mkdtemp(prefix="tabsense-ingest-")


def _put(folder, name, content):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content if isinstance(content, bytes) else content.encode())
    return path


def _workbook(rows):
    def cell(r, c, v):
        at = f"{chr(65 + c)}{r + 1}"
        return "" if v is None else f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
    body = "".join(f'<row r="{r + 1}">{"".join(cell(r, c, v) for c, v in enumerate(row))}</row>' for r, row in enumerate(rows))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml",
                   '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
                   f"<sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def _files(folder):
    _put(folder, "a.csv", "a,b,b\n1,x,2.5\n2,NA,\n")
    _put(folder, "sub dir/b 1.csv", "b,a\nTrue,1\n")
    _put(folder, "lat.csv", "näme,v\né,1\n".encode("latin-1"))
    _put(folder, "quoted.csv", 'a,b\n"x\ny",1\n')
    _put(folder, "t.tsv", "p\tq\n1\t2\n3\t4\n")
    _put(folder, "lines.json", '{"a":1,"b":1.5,"e":{"k":1,"m":[1]}}\n\n{"a":2,"c":null}\n')
    _put(folder, "array.json", ' \n[{"x":true,"y":"t"},{"x":false}]')
    _put(folder, "half.json", '{"a":1}\nnope\n')
    _put(folder, "w.xlsx", _workbook([["h", None, "h"], ["1", "u", "2.5"], [None, "v", "3"]]))


def test_facts_equal_reading_each_file(spark):
    land = _folder()
    _files(land)
    rows = ingest_folder(spark, land, os.path.join(_folder(), "c"), "s").collect()
    assert len(rows) == 9
    for r in rows:
        df = S.read_any(spark, r.filepath)
        assert (r.status, r.row_count, r.column_count) == ("registered", df.count(), len(df.columns)), r.filename
        assert r.schema_json == dict(df.dtypes), r.filename


def test_rejected_files_say_why(spark):
    land = _folder()
    _put(land, "head.csv", "a,b\n")
    _put(land, "empty.csv", "")
    _put(land, "blank.json", " \n\n")
    _put(land, "broken.xlsx", b"no zip")
    _put(land, "old.xls", b"x")
    _put(land, "big.csv", "a\n" + "1\n" * 3000)
    _put(land, "x.exe", "x")
    got = {r.filename: (r.status, r.reason) for r in
           ingest_folder(spark, land, os.path.join(_folder(), "c"), "s", max_mb=0.005).collect()}
    assert all(status == "rejected" for status, _ in got.values()) and len(got) == 6    # a file without bytes is never listed
    assert got["head.csv"][1] == got["blank.json"][1] == "no data in file"
    assert got["broken.xlsx"][1].startswith("unreadable: ") and got["old.xls"][1].startswith("unreadable: ")
    assert got["big.csv"][1] == "file larger than 0.005 MB"
    assert got["x.exe"][1] == "unsupported file type .exe"


def test_repeats_are_kept_out_without_stream_state(spark):
    land, catalog = _folder(), os.path.join(_folder(), "c")
    _put(land, "one/a.csv", "a\n1\n")
    _put(land, "two/a.csv", "a\n2\n")                      # same name and length, same batch
    first = ingest_folder(spark, land, catalog, "s")
    assert [r.filepath.split("/")[-2] for r in first.collect()] == ["one"]
    _put(land, "three/a.csv", "a\n3\n")                    # a later batch
    _put(land, "b.csv", "a\n1\n")
    assert sorted(r.filename for r in ingest_folder(spark, land, catalog, "s").collect()) == ["a.csv", "b.csv"]
    ids = {r.id for r in ingest_folder(spark, land, catalog, "s").collect()}
    replay = ingest_folder(spark, land, catalog, "s", checkpoint=os.path.join(_folder(), "ck"), max_files_per_batch=1)
    rows = replay.collect()
    assert len(rows) == 2 and {r.filename for r in rows} == {"a.csv", "b.csv"} and len(ids) == 2


def test_two_folders_share_a_catalog(spark):
    catalog = os.path.join(_folder(), "c")
    for n, session in ((1, "s"), (2, "s"), (1, "17")):
        land = _folder()
        _put(land, f"f{n}.csv", "a\n" + "1\n" * n)
        got = ingest_folder(spark, land, catalog, session)
    assert sorted((r.session_id, r.filename, r.row_count) for r in got.collect()) == [
        ("17", "f1.csv", 1), ("s", "f1.csv", 1), ("s", "f2.csv", 2)]


def test_ingest_stream_keeps_no_state(spark):
    land, ck = _folder(), os.path.join(_folder(), "ck")
    _put(land, "a.csv", "a\n1\n")
    ingest_folder(spark, land, os.path.join(_folder(), "c"), "s", checkpoint=ck)
    assert os.path.isdir(os.path.join(ck, "offsets")) and not os.path.exists(os.path.join(ck, "state"))
