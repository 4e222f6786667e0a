from codesift.operators.scan import scan_sources
from codesift.plans.rescan import pack_key, rescan, stored_results
from codesift.rules import Rule
from codesift.solidity import solidity_rules

SOURCE = "path string, content string"


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), SOURCE)


def rows(found):
    return sorted((r.path, r.file_name, r.lines_of_code, r.solidity_version, [(f.rule_order, f.line, f.code_snippet) for f in r.findings]) for r in found.collect())


def test_only_changed_texts_are_scanned(spark, tmp_path):
    store, pack = str(tmp_path), solidity_rules()
    first = {f"/d{i % 3}/f{i}.sol": f"tx.origin; // {i % 20}" for i in range(40)} | {"/null.sol": None, "/empty.sol": ""}
    sources = frame(spark, first)
    assert rows(rescan(sources, pack, store)) == rows(scan_sources(sources, pack))
    assert stored_results(spark, pack, store).count() == 21
    second = first | {"/d0/f0.sol": "selfdestruct(a);", "/new/a.sol": "admin = x;", "/new/b.sol": "admin = x;", "/null.sol": "x"}
    counter = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            counter.add(int((batch["content"].str.len() > 0).sum()))
            yield batch

    changed = frame(spark, second)
    assert rows(rescan(changed, pack, store)) == rows(scan_sources(changed, pack))
    assert stored_results(spark, pack, store).count() == 24
    again = rescan(changed.mapInPandas(count, SOURCE), pack, store)
    assert rows(again) == rows(scan_sources(changed, pack)) and stored_results(spark, pack, store).count() == 24


def test_another_pack_has_results_of_its_own(spark, tmp_path):
    store, pack = str(tmp_path), solidity_rules()
    more = pack.plus(Rule("N-1", "t", "d", "LOW", "", "", "", (), r"\bnew\b"))
    sources = frame(spark, {"/a.sol": "new x; tx.origin;"})
    assert len(rows(rescan(sources, pack, store))[0][4]) == 1
    assert len(rows(rescan(sources, more, store))[0][4]) == 2
    assert rows(rescan(sources, more, store, "high")) == rows(scan_sources(sources, more.at_least("high")))
    assert len({pack_key(p) for p in (pack, more, more.at_least("high"))}) == 3


def test_repeated_paths_and_texts(spark, tmp_path):
    sources = spark.createDataFrame([("/a.sol", "tx.origin;"), ("/a.sol", "x"), ("/b.sol", "x"), ("/b.sol", "x")], SOURCE)
    assert rows(rescan(sources, solidity_rules(), str(tmp_path))) == rows(scan_sources(sources, solidity_rules()))
    assert rescan(sources.where("false"), solidity_rules(), str(tmp_path)).count() == 0
