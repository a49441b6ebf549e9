import pytest

from .test_text_ops import EDGE


@pytest.fixture
def edge(rows):
    """Texts at the edges, with columns whose names clash with results."""
    return rows([(i, t, "x", 1) for i, t in EDGE], "doc_id bigint, text string, n_tokens string, start int")
