"""All registered queries; importing the package fills the registry."""

from docrecon.catalog import (  # noqa: F401
    answer_key, checks, chunks, documents, links, timings, whole_path,
)
from docrecon.catalog.registry import QUERIES, SQL  # noqa: F401
