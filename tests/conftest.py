import os
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from leafmill.session import local_session  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LONG = "The long page went on and on, and nobody knew why it never ended. " * 3000


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return DATA


def _tables():
    return sorted(f[:-8] for f in os.listdir(DATA) if f.endswith(".parquet"))


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory):
    """All tables without rows."""
    d = tmp_path_factory.mktemp("empty")
    for t in _tables():
        pq.write_table(pq.read_table(f"{DATA}/{t}.parquet").slice(0, 0), d / f"{t}.parquet")
    return str(d)


@pytest.fixture(scope="session")
def edge_dir(tmp_path_factory):
    """All tables with rows of nulls, empty and very long texts, every row twice, and columns whose names operators use themselves."""
    d = tmp_path_factory.mktemp("edge")
    for t in _tables():
        rows = pq.read_table(f"{DATA}/{t}.parquet")
        rows = rows.slice(0, 60)
        more = []
        first = rows.slice(0, 1)
        keys = {"documents": "doc_id", "annotations": "event_id", "change_log": "change_id", "articles": "article_id", "layout_regions": "issue", "page_meta": "issue", "stage_pages": "issue", "pilot_issues": "id"}
        for k, column in enumerate(rows.schema):
            if column.name == keys.get(t) or t in ("mix_targets", "pack_specs", "name_authority"):
                continue
            one = first.set_column(k, column, pa.nulls(1, column.type))
            at = rows.schema.get_field_index(keys[t]) if t in keys else -1
            if at >= 0 and pa.types.is_integer(rows.schema.field(at).type):
                one = one.set_column(at, rows.schema.field(at), pa.array([900_000 + k], rows.schema.field(at).type))
            more.append(one)
        if "text" in rows.schema.names:
            at = rows.schema.get_field_index("text")
            for k, text in enumerate(["", " \n\n ", LONG, "a", "-\n", "|", "​"]):
                one = first.set_column(at, rows.schema.field(at), pa.array([text]))
                key = rows.schema.get_field_index(keys.get(t, "text"))
                if pa.types.is_integer(rows.schema.field(key).type):
                    one = one.set_column(key, rows.schema.field(key), pa.array([910_000 + k], rows.schema.field(key).type))
                more.append(one)
        out = pa.concat_tables([rows, *more])
        out = pa.concat_tables([out, out])
        for name in ("_text", "_h", "word", "n", "_t", "class_key", "doc", "_n", "kind2", "_key"):
            if name not in out.schema.names:
                out = out.append_column(name, pa.array(["clash"] * out.num_rows))
        pq.write_table(out, d / f"{t}.parquet")
    return str(d)
