"""Readers by the kind of source."""

from __future__ import annotations

from . import feed, files, tables, web

READERS = {"files": files.listing, "rows": tables.row_documents, "crawl": web.crawl, "sitemap": web.sitemap, "jdbc": tables.read_jdbc, "feed": feed.changes}
