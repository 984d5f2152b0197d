"""DataFrame operators on pages and nodes."""

from .pages import find_nodes, html_errors, html_events, parse_html, run, transform_errors
from .nodes import attr, nodes_to_pages, parse_nodes, select, select_one, to_text, transform_nodes

__all__ = ["attr", "find_nodes", "html_errors", "html_events", "nodes_to_pages", "parse_html", "parse_nodes", "run", "select", "select_one", "to_text", "transform_errors", "transform_nodes"]
