"""Alignment and whole comparisons; all end-to-end cases are pairs of one run."""

import random

import pytest

from variorum import storage
from variorum.operators import align as A
from variorum.plans import compare as C
from variorum.plans import report as R
from variorum.schema import BLOCKS

P, H, L = "paragraph", "heading", "list"


def row(*cells, table="t1"):
    return ("tableRow", " | ".join(cells), list(cells), table)


CASES = {
    "number in a sentence": ([(P, "Revenue was 100 units this year.")], [(P, "Revenue was 250 units this year.")]),
    "cell": ([row("Growth", "2.3%")], [row("Growth", "5.7%")]),
    "headings": ([(H, "Alpha banner"), (H, "Second label")], [(H, "Zulu words here"), (H, "Other text now")]),
    "deleted": ([(P, "First paragraph stays here."), (P, "Second one vanishes entirely.")], [(P, "First paragraph stays here.")]),
    "added": ([(P, "First paragraph stays here.")], [(P, "First paragraph stays here."), (P, "Brand new closing words.")]),
    "paragraph to row": ([(P, "Move this content over"), (P, "Keep this paragraph as it is.")], [(P, "Keep this paragraph as it is."), row("Move this content over")]),
    "row to list": ([row("Item alpha to be moved"), (P, "Steady text remains.")], [(P, "Steady text remains."), (L, "Item alpha to be moved")]),
    "numbers only headings": ([(H, "1")], [(H, "2")]),
    "identical": ([(H, "Title"), (P, "One. Two. Three."), row("a", "b")], [(H, "Title"), (P, "One. Two. Three."), row("a", "b")]),
    "empty output": ([(P, "Something there.")], []),
}


@pytest.fixture(scope="module")
def compared(spark):
    rows = []
    for n, (src, out) in enumerate(CASES.values()):
        for side, blocks in (("src", src), ("out", out)):
            for i, b in enumerate(blocks):
                kind, text, cells, table = (*b, None, None)[:4]
                rows.append((n, side, 0, "Section", None, None, i, kind, text, cells, table, i if table else None))
    result = C.compare_documents(spark.createDataFrame(rows, BLOCKS))
    names = list(CASES)
    stats = {names[r.pair_id]: r for r in result.stats.collect()}
    details: dict[str, list] = {n: [] for n in names}
    tables: dict[str, list] = {n: [] for n in names}
    for r in result.detail_rows.orderBy("block_id").collect():
        details[names[r.pair_id]].append(r)
    for r in result.table_rows.orderBy("block_id").collect():
        tables[names[r.pair_id]].append(r)
    return stats, details, tables, result


def test_end_to_end(compared):
    stats, details, tables, _ = compared
    assert stats["number in a sentence"].modified == 1 and details["number in a sentence"][0].comments == "Number removed: 100 | Number added: 250"
    cell = tables["cell"][0]
    assert cell.status == "modified" and cell.cell_diffs[1].status == "modified" and (cell.cell_diffs[1].src_text, cell.cell_diffs[1].out_text) == ("2.3%", "5.7%")
    assert stats["cell"].reformatted == 0
    assert stats["headings"].modified == 2 and details["headings"][0].comments == "Content replaced"
    assert stats["deleted"].missing == 1 and stats["added"].added == 1
    for name in ("paragraph to row", "row to list"):
        assert (stats[name].missing, stats[name].added, stats[name].reformatted) == (0, 0, 2), name
    assert stats["numbers only headings"].modified == 1 and stats["numbers only headings"].reformatted == 0
    s = stats["identical"]
    assert (s.match_percentage, s.modified, s.missing, s.added, s.matched) == (100.0, 0, 0, 0, 5)
    assert stats["empty output"].missing == 1 and details["empty output"][0].comments == "Entire section removed"


def test_block_ids_run(compared):
    _, details, tables, _ = compared
    for name in CASES:
        ids = sorted(r.block_id for r in details[name] + tables[name])
        assert ids == list(range(1, len(ids) + 1))


def test_report(spark, compared):
    result = compared[3]
    rows = R.all_rows(result.detail_rows, result.table_rows)
    assert R.preview(rows).count() <= rows.count()
    exported = R.redline(R.to_export(rows))
    assert {r.status for r in exported.select("status").distinct().collect()} >= {"Match", "Modified", "Reformatted"}
    assert R.summary_cards(result.stats).count() == 9 * result.stats.count()
    assert R.number_changes(result.detail_rows).count() >= 1
    assert R.section_counts(rows).count() == len(CASES)


def _items(spark, lists):
    rows = [(g, i, k, k) for g, keys in enumerate(lists) for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "g long, idx int, key string, text string")


def test_align(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta"]
    src = [["a", "b", "c"], ["one sentence with a last word", "x"], ["pppp", "qqqq", "rrrr"]]
    out = [["c", "a", "b"], ["one sentence with a last term", "yyyyyy"], ["1111", "2222"]]
    for _ in range(6):
        src.append([" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 8))])
        out.append([" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 8))])
    a, b = _items(spark, src), _items(spark, out)
    ops = A.align(a, b, ["g"], 0.45, positional_fallback=True).orderBy("g", "op_pos").collect()
    by = {g: [(o.type, o.src_idx, o.out_idx) for o in ops if o.g == g] for g in range(len(src))}
    assert {t for t, _, _ in by[0]} == {"match"}
    assert ("modify", 0, 0) in by[1]
    assert by[2] == [("modify", 0, 0), ("modify", 1, 1), ("delete", 2, None)]
    for g, found in by.items():
        assert sorted(s for _, s, _ in found if s is not None) == list(range(len(src[g])))
        assert sorted(o for _, _, o in found if o is not None) == list(range(len(out[g])))
    none = A.align(a, b, ["g"], 0.45).where("g = 1").collect()
    assert {o.type for o in none} == {"modify", "delete", "insert"}


def test_band_equals_full_scan_where_it_covers(spark):
    a, b = _items(spark, [[f"s{i}" for i in range(30)]]), _items(spark, [[f"o{i}" for i in range(20)]])
    full = {(r.src_idx, r.out_idx) for r in A.candidates(a, b, ["g"]).collect()}
    banded = {(r.src_idx, r.out_idx) for r in A.candidates(a, b, ["g"], full_scan=599).collect()}
    assert len(full) == 600 and banded <= full and {(i, min(19, int(i / 30 * 20 + 0.5))) for i in range(30)} <= banded


def test_texts_are_stored_few_times(spark, monkeypatch, tmp_path):
    """F2 to F5: what lies in the shared folder at any write is a few times the texts, and tables that are done with go."""
    words = [f"{i * 7919 % 99991:05d}" for i in range(60_000)]
    lines = [" ".join(words[i : i + 100]) for i in range(0, len(words), 100)]
    rows = [(n, side, 0, "Section", None, None, i, P, t if side == "src" or i % 7 else t[:300] + " Changed.", None, None, None) for n in range(2) for side in ("src", "out") for i, t in enumerate(lines[n * 300 : n * 300 + 300])]
    monkeypatch.setattr(storage, "shared_folder", lambda _: f"file://{tmp_path}")
    sizes = []
    writer = storage._writer

    def watched(df, codec):
        sizes.append(sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")))
        return writer(df, codec)

    monkeypatch.setattr(storage, "_writer", watched)
    result = C.compare_documents(spark.createDataFrame(rows, BLOCKS))
    assert sum(r.matched for r in result.stats.collect()) > 400 and result.paragraphs.where("size(sentences) > 0").count() == 1200
    plain = tmp_path / "texts"
    spark.createDataFrame(rows, BLOCKS).select("side", "text").write.parquet(str(plain))
    assert max(sizes) < 3 * sum(p.stat().st_size for p in plain.rglob("*.parquet"))
