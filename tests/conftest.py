from __future__ import annotations

import pytest

from codeloom.schemas import ANNOTATION, Graph
from codeloom.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]",
        **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def notes(spark):
    """Annotations from (path, imports, exports, lines) tuples of repository r."""
    def make(*rows, repo="r"):
        full = []
        for row in rows:
            path, imports, exports, lines = (list(row) + [[], [], 10][len(row) - 1:])[:4]
            full.append((repo, path, "TypeScript", 100, lines, f"About {path}", list(exports), list(imports)))
        return spark.createDataFrame(full, ANNOTATION)

    return make


@pytest.fixture
def graph_of(spark):
    """Graph from {path: (imports, imported_by)}."""
    def make(nodes, repo="r"):
        rows = lambda pairs, name: spark.createDataFrame([(repo, p, t) for p, t in pairs], f"repo string, path string, {name} string")
        return Graph(
            spark.createDataFrame([(repo, p) for p in nodes], "repo string, path string"),
            rows([(p, t) for p, (i, _) in nodes.items() for t in i], "target"),
            rows([(p, t) for p, (_, b) in nodes.items() for t in b], "importer"),
        )

    return make


@pytest.fixture
def table(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())
