"""HTML as lines of text, by expressions alone: headings, list items, paragraphs, links, and no noise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is dropped whole. Nothing here nests in itself on a sane page.
DROPPED = r"(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>|<noscript.*?</noscript>|<template.*?</template>|<nav.*?</nav>|<footer.*?</footer>|<aside.*?</aside>|<head>.*?</head>"
BLOCKS = r"(?i)</?(?:p|div|section|article|main|ul|ol|table|tr|td|th|br|h[1-6]|li|blockquote)(?:\s[^>]*)?/?>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def rendered(html: Column | str) -> Column:
    """Lines: # for a heading of level 1 and so on, - for a list item, `text (target)` for a link."""
    t = F.regexp_replace(html, DROPPED, "")
    t = F.regexp_replace(t, r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', "$2 ($1)")
    for level in range(1, 7):
        t = F.regexp_replace(t, rf"(?i)<h{level}(?:\s[^>]*)?>", "\n" + "#" * level + " ")
    t = F.regexp_replace(t, r"(?i)<li(?:\s[^>]*)?>", "\n- ")
    t = F.regexp_replace(F.regexp_replace(t, BLOCKS, "\n"), "<[^>]*>", "")
    for entity, character in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(character))
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike("^(?:#+|-)$")), "\n")


def line_kind(line: Column) -> Column:
    return F.when(line.rlike("^#{1,6} "), "heading").when(line.startswith("- "), "list_item").otherwise("paragraph")
