"""States kept up by loads, against the full views after every step."""

import pytest

from gondola.operators import kept, shelf, views
from gondola.schema import PRICING, SHELF
from gondola.sources import ingest, states
from gondola.sources.states import Kept
from gondola.sources.versions import VersionedTable

PRICES = [
    ("a", "NIKE", "F1", "D1", 10.25, 0.125, 3, "BEAT"), ("a", "NIKE", "F1", None, 11.5, None, None, "N/D"), ("a", "Puma", "", "D1", None, -0.5, 2, None), (None, None, None, None, None, None, None, None),
    ("b", "ADIDAS", "F2", "D2", 99999.99, 12.5, 1, "LOSE"), ("b", "ADIDAS", "F2", "D2", 0.01, 0.000001, 7, "MEET"), ("URU", "NIKE", "F1", "D1", 5.0, 0.1, 1, "BEAT"), ("a", "NIKE", "F1", "D1", 10.25, 0.125, 3, "BEAT"),
]
SEEN = [("c", "t1", "Nike", 5.0), ("c", "t1", "Adidas", 5.0), ("c", "t1", "Nike", 9.5), ("c", "t2", "Puma", None), ("c", "t3", "Topper", float("nan")), ("c", "t3", "Nike", 1.0), ("d", "t1", "Puma", 0.1), ("d", "t1", "puma", 0.3), ("d", "t1", "Adidas", 0.1), ("d", "t1", "Adidas", 0.1)]
VIEWS = [(kept.bml_summary, views.bml_summary), (kept.franchise_summary, views.franchise_summary), (kept.shelf_share, views.shelf_share)]
QUESTIONS = [(kept.winners, shelf.winners), (kept.term_totals, shelf.term_totals), (kept.shelf_shares, shelf.shelf_shares), (kept.search_table, shelf.search_table)]
QUESTIONS += [(lambda s, b=b: kept.brand_visibility(s, b, True), lambda s, b=b: shelf.brand_visibility(s, b, True)) for b in ("Nike", "Puma", "none")]


@pytest.fixture
def prices(spark, tmp_path):
    class Table:
        table = VersionedTable(spark, f"{tmp_path}/prices")
        state = Kept(table, kept.PRICE_STATE)

        def load(self, rows, **more):
            names = "scraper string, marca string, franchise_competitor string, division_competitor string, competitor_final_price double, gap_final_price_pct double, size_available_competitor int, bml_final_price string"
            ingest.append(spark.createDataFrame(rows, names), self.table.path, **more)

    return Table()


def lines(df):
    return df.columns, sorted(map(str, df.collect()))


def same(state, rows, pairs):
    for of_state, of_rows in pairs:
        assert lines(of_state(state.rows())) == lines(of_rows(rows()))


def test_views_follow_every_load(spark, prices):
    full = lambda: ingest.read_prices(spark, prices.table.path)
    same(prices.state, full, VIEWS)  # no load yet
    assert prices.state.refresh() == 0
    prices.state.compact()
    steps = [lambda n=n: prices.load(PRICES[n : n + 3], truncate=n == 4) for n in range(0, 8, 2)]
    for step in [*steps, lambda: prices.load([])]:
        step()
        same(prices.state, full, VIEWS)  # before the refresh, the new load as it is read
        prices.state.refresh()
        assert prices.state.refresh() == 0
        same(prices.state, full, VIEWS)
    prices.state.compact()
    same(prices.state, full, VIEWS)
    prices.load(PRICES)
    same(prices.state, full, VIEWS)
    prices.load(PRICES[:2], truncate=True)  # the fold doesn't fit any more
    same(prices.state, full, VIEWS)
    prices.state.vacuum()
    same(prices.state, full, VIEWS)
    assert not prices.state._names("fold") and not prices.state._names("run")


def test_only_new_files_are_read(spark, prices):
    prices.load(PRICES)
    prices.load(PRICES[:1])
    prices.state.refresh()
    prices.load(PRICES[1:2], run_id="new")
    read = prices.state.rows().inputFiles()
    assert read and all("/views/prices/run=" in f or "/data/run=new/" in f for f in read) and any("run=new" in f for f in read)
    prices.state.refresh()
    assert all("/views/prices/run=" in f for f in prices.state.rows().inputFiles())
    prices.state.compact()
    assert all("/views/prices/fold=" in f for f in prices.state.rows().inputFiles())
    assert prices.state.refresh() == 0
    prices.state.vacuum()
    assert not prices.state._names("run") and prices.state.refresh() == 0


def test_older_versions(spark, prices):
    prices.load(PRICES)
    old = prices.table.numbers()[-1]
    before = lines(kept.bml_summary(prices.state.rows()))
    prices.state.refresh()
    prices.load(PRICES)
    prices.state.refresh()
    prices.state.compact()
    assert lines(kept.bml_summary(prices.state.rows(old))) == before != lines(kept.bml_summary(prices.state.rows()))
    assert sum(r.n for r in prices.state.rows(old).collect()) == len(PRICES)


def test_a_refresh_that_stops_or_comes_second(spark, prices, monkeypatch):
    prices.load(PRICES)
    wanted = lines(kept.bml_summary(prices.state.rows()))

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "rename", stop)
        with pytest.raises(KeyboardInterrupt):
            prices.state.refresh()
    assert not prices.state._names("run") and lines(kept.bml_summary(prices.state.rows())) == wanted
    real = prices.state._names
    with monkeypatch.context() as m:  # a second refresh that had looked before the first was done
        prices.state.refresh()
        m.setattr(prices.state, "_names", lambda kind: set())
        assert prices.state.refresh() == 1
    assert len(real("run")) == 1 and lines(kept.bml_summary(prices.state.rows())) == wanted
    drafts = lambda: [n for n in prices.table.children(prices.state.path) if n.startswith(".draft")]
    prices.state.vacuum()
    assert len(drafts()) == 1  # of the stopped one; it might still be at work
    monkeypatch.setattr(states, "DEAD_DRAFT_S", -1)
    prices.state.vacuum()
    assert not drafts() and lines(kept.bml_summary(prices.state.rows())) == wanted


def test_shelf_questions_follow_every_load(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/shelf")
    state = Kept(table, kept.SHELF_STATE)
    full = lambda: ingest.read_shelf(spark, table.path)
    same(state, full, QUESTIONS)
    for n in range(0, len(SEEN), 3):
        ingest.append(spark.createDataFrame(SEEN[n : n + 4], "canal string, search_term string, marca string, nike_visibility double"), table.path, "shelf", truncate=n == 3)
        same(state, full, QUESTIONS)
        state.refresh()
        same(state, full, QUESTIONS)
    rows = full()
    assert rows.schema.fieldNames() == SHELF.fieldNames() and sorted(r.id for r in rows.collect()) == list(range(1, rows.count() + 1))
    state.compact()
    assert state.rows().count() == rows.select("canal", "search_term", "marca").distinct().count()
    same(state, full, QUESTIONS)


def test_appended_rows(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.createDataFrame([("a", 7, "x")], "scraper string, id int, more string")
    assert ingest.append(rows, path, run_id="r").inserted == 1
    assert ingest.append(rows, path, run_id="r").inserted == 1  # it is done
    found = ingest.read_prices(spark, path)
    assert found.schema.fieldNames() == PRICING.fieldNames() and [(r.id, r.scraper) for r in found.collect()] == [(1, "a")]
    with pytest.raises(Exception, match="canal"):
        ingest.append(spark.createDataFrame([(None, "t", "m")], "canal string, search_term string, marca string"), path, "shelf")
