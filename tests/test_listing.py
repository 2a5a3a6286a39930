"""Files as rows: empty ones, many, globs, and folders that Spark's readers take or leave."""

import pytest

from keyloom import sources
from keyloom.sources.listing import ListingReader, alternatives


def names(df, root):
    return sorted(r["path"].removeprefix(f"file:{root}/") for r in df.collect())


@pytest.fixture
def root(tmp_path):
    for name, text in {
        "a.txt": "one", "b.txt": "", "c d+é%20.txt": "", "e.csv": "x", "_SUCCESS": "", ".hidden": "no",
        "deep/below.txt": "not read", "k=1/x.txt": "", "k=1/l=2/y.txt": "yy", "k=2/_tmp": "", "k=2/z.txt": "z",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(tmp_path)


def test_listing(spark, root):
    files = sources.list_files(spark, [root])
    right = ["a.txt", "b.txt", "c d+é%20.txt", "e.csv"]
    assert names(files, root) == sorted([*right, "k=1/l=2/y.txt", "k=1/x.txt", "k=2/z.txt"])
    assert {r["length"] for r in files.collect()} == {0, 1, 2, 3}
    assert names(sources.list_files(spark, [f"{root}/*.txt"]), root) == ["a.txt", "b.txt", "c d+é%20.txt"]
    assert names(sources.list_files(spark, [f"{root}/[ab].t?t", f"file:{root}/e.csv"]), root) == ["a.txt", "b.txt", "e.csv"]
    assert names(sources.list_files(spark, [root + "/{a,e}.{txt,csv}"]), root) == ["a.txt", "e.csv"]
    assert names(sources.list_files(spark, [f"{root}/k=*/x.txt"]), root) == ["k=1/x.txt"]
    assert sources.list_files(spark, [f"{root}/none", f"{root}/z*"]).count() == 0


def test_a_folder_is_a_partition(root):
    parts = ListingReader([root, f"{root}/k=*"]).partitions()
    told = sorted((p.uri.removeprefix(f"file:{root}"), p.deep) for p in parts)
    assert told == [("", False), ("/k=1", False), ("/k=1", True), ("/k=1/l=2", True), ("/k=2", False), ("/k=2", True)]


def test_braces():
    assert alternatives("a{b,c{d,e}}f") == ["abf", "acdf", "acef"]
    assert alternatives("plain") == ["plain"]


def test_empty_files_are_rows(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"f{i:03}.txt").write_text("" if i % 3 == 0 else "x" * i)
    texts = {r["path"]: r["content"] for r in sources.whole_text_files(spark, str(tmp_path)).collect()}
    files = {r["path"]: (r["length"], bytes(r["content"])) for r in sources.binary_files(spark, str(tmp_path)).collect()}
    assert len(texts) == len(files) == 300 and set(texts) == set(files)
    for path, text in texts.items():
        i = int(path[-7:-4])
        assert text == ("" if i % 3 == 0 else "x" * i) and files[path] == (len(text), text.encode())


def test_odd_names(spark, root):
    texts = {r["path"].rsplit("/", 1)[1]: r["content"] for r in sources.whole_text_files(spark, root + "/*.txt").collect()}
    assert texts == {"a.txt": "one", "b.txt": "", "c d+é%20.txt": ""}
