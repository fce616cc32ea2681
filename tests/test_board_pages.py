import pytest

from postmill.operators.extract import rows_of
from postmill.plans.queries import ORACLE_SQL, QUERIES
from postmill.sources.boards import BOARDS
from tests.oracle import same
from tests.test_extract import a, body, tr


@pytest.fixture(scope="module")
def without_text(spark, tmp_path_factory):
    """Documents without text, each at a row of every kind."""
    folder = tmp_path_factory.mktemp("tables")
    rows = [(n, (None, "", " \n", "[x] y", "z")[n // 60], "en", "src1", 0) for n in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_titles_of_documents_without_text(spark, without_text):
    assert same(spark, QUERIES["board_museum_or_kr"], ORACLE_SQL["board_museum_or_kr"], without_text) == 180


def test_titles_by_specs_of_documents_without_text(spark, without_text):
    same(spark, QUERIES["spec_boards"], ORACLE_SQL["spec_boards"], without_text)


def test_an_empty_first_child_gives_all_text():
    page = lambda title: body(tr(1, f'{a("", "v/1")}<div class="kboard-default-cut-strings">{title}</div>', 3, "2026.03.01"))
    titles = [[r["title"] for r in rows_of(BOARDS["museum-or-kr"], page(t))] for t in ("<b></b> tail", "<b> </b> tail", "<b> t</b> tail", " <b>t</b>")]
    assert titles == [["tail"], [""], ["t"], [""]]
