import pyspark.sql.functions as F
import pytest

from quillmark.functions import text as T
from quillmark.functions import vectors as V
from quillmark.operators import chunk as C
from quillmark.operators import notes as N


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "path, folders, files, want",
    [
        ("a/node_modules/x.md", "", "", True),
        ("Projects/Archive/note.md", "Archive", "", True),
        ("Projects/Archive/note.md", "Projects/Archive", "", True),
        ("Projects/Archive-2/note.md", "Projects/Archive", "", False),
        ("Notes/daily-log.md", "", "daily", True),
        ("daily/note.md", "", "daily", False),
        ("a/b.md", " , ", "", False),
    ],
)
def test_is_excluded(spark, path, folders, files, want):
    assert one(spark, T.is_excluded(F.col("p"), F.col("f"), F.col("g")), p=path, f=folders, g=files) is want


def test_breadcrumbs(spark):
    assert one(spark, T.breadcrumbs(F.col("k")), k="a/b.md#H1#H2") == "a > b > H1"
    assert one(spark, T.breadcrumbs(F.col("k")), k="a/b.md") == ""


def test_trim_and_shrink(spark):
    long = "word " * 400
    cut = one(spark, T.trim_to_tokens(F.col("t"), 100), t=long)
    assert cut and -(-len(cut) // 3.7) <= 101 and not cut.endswith("wor")
    assert one(spark, T.trim_to_tokens(F.col("t"), 1), t=long) is None
    assert one(spark, T.trim_to_tokens(F.col("t"), 100), t="short") == "short"
    assert len(one(spark, T.shrink_to_tokens(F.col("t"), 50), t=long)) <= 185


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 0.0], 0.0), ([1.0, 0.0], [1.0], None)], "a array<float>, b array<float>, w double")
    for r in df.withColumn("s", V.cosine(F.col("a"), F.col("b"))).collect():
        assert r.s == r.w
    with pytest.raises(Exception):
        df.select(V.cosine(F.col("a"), F.col("b"), strict=True)).collect()


def chunks(spark, text):
    return {r.entity_key: r for r in C.chunk_notes(spark.createDataFrame([("n.md", text)], "path string, text string")).collect()}


def test_paragraphs(spark):
    got = chunks(spark, f"short\n\n{'a' * 120}\n\n{'b' * 99}\n\n\n{'c' * 100}\nd")
    assert sorted(got) == ["n.md#paragraph-2", "n.md#paragraph-4"]
    assert (got["n.md#paragraph-4"].start_line, got["n.md#paragraph-4"].end_line) == (7, 8)
    assert chunks(spark, "") == {} and chunks(spark, "  \n \t") == {} and chunks(spark, None) == {}


def test_sections(spark):
    got = chunks(spark, "lost\n# A\nx\n## B\ny\n#### deep\nz\n## B\nagain\n# C\n```\n# not one\n```")
    assert sorted(got) == ["n.md#A", "n.md#A#B", "n.md#C"]
    assert got["n.md#A"].text == "# A\nx\n## B\ny\n#### deep\nz\n## B\nagain"
    assert got["n.md#A#B"].start_line == 7  # the last of two equal keys
    skipped = chunks(spark, "# A\n### C\nx\n## B\ny")
    assert "n.md#A#C" in skipped and "n.md#A#B" in skipped


def test_section_paragraphs(spark):
    body = f"{'p' * 500}\n\n{'q' * 150}\n#tag\n{'r' * 600}"
    got = chunks(spark, f"# A\n{body}")
    assert [got[k].text[0] for k in ("n.md#A#paragraph-1", "n.md#A#paragraph-2")] == ["p", "r"]
    assert got["n.md#A#paragraph-2"].headings == ["A", "paragraph-2"]


def test_coverage(spark):
    rows = [("n.md#H", 1000), ("n.md#H#paragraph-1", 350), ("n.md#H#paragraph-2", 300), ("n.md#H#paragraph-3", 300), ("n.md#K", 1000), ("n.md#K#paragraph-1", 500), ("n.md#S", 100)]
    blocks = spark.createDataFrame(rows, "entity_key string, length bigint")
    got = {r.entity_key: r.should_embed for r in C.eligible_blocks(blocks).collect()}
    assert not got["n.md#H"] and got["n.md#K"] and got["n.md#H#paragraph-1"] and not got["n.md#S"]


def test_scan_and_read(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "a.md").write_text("# A\ntext")
    (tmp_path / "sub dir" / "b.md").write_text("b")
    (tmp_path / "c.txt").write_text("no")
    notes = N.scan_notes(spark, str(tmp_path))
    assert sorted(r.path for r in notes.collect()) == ["a.md", "sub dir/b.md"]
    assert N.read_note(notes, "a.md").first().text == "# A\ntext"
    assert N.read_note(notes, "x.md").first().found is False
    got = N.multi_get(notes, ["x.md", "", "a.md"]).collect()
    assert [(r.path, r.status) for r in got] == [("x.md", "note_not_found"), ("a.md", "ok")]


def test_chunks_where_only_some_notes_may_have_headings(spark):
    from quillmark.operators import chunk as C

    word = "words " * 30
    rows = [("plain.md", word), ("tag.md", f"#tag {word}"), ("fence.md", f"```\n# no heading\n```\n\n{word}"), ("late.md", f"{word}\n## A\n{word}"), ("null.md", None), ("deep.md", f"####### seven\n\n{word}")]
    got = sorted(r.entity_key for r in C.chunk_notes(spark.createDataFrame(rows, "path string, text string")).collect())
    assert got == ["deep.md#paragraph-2", "fence.md#paragraph-2", "late.md#A", "plain.md#paragraph-1", "tag.md#paragraph-1"]
