"""Column functions."""

from .text import normalize_ws, page_title, strip_html, terms, url_host
from .vectors import cosine, dot, l2_distance, norm

__all__ = ["cosine", "dot", "l2_distance", "norm", "normalize_ws", "page_title", "strip_html", "terms", "url_host"]
