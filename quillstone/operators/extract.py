"""Fields of web pages as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.lexicons import AUTHOR_TITLE_HOSTS
from quillstone.functions.text import strip, unescape_entities

# Hosts whose pages keep their numbers, and where they keep them; prefixes that a forum's address goes by; what shows that a page has content.
SOCIAL_HOST = "facebook.com"
REACTIONS = r'"reaction_count":\{"count":(\d+)'
COMMENTS = r'"comment_rendering_instance":\{"comments":\{"total_count":(\d+)'
CREATED = r'"creation_time":(\d+)'
FORUM_HOST, FORUM_CANONICAL = "reddit.com", "old.reddit.com"
FORUM_PREFIXES = r"https?://(www\.|np\.|new\.)?"
FORUM_SCORE = r'class="score unvoted"[^>]*title="(\d+)"'
FORUM_COMMENTS = r'data-comments-count="(\d+)"'
FORUM_TIME = r'data-timestamp="(\d+)"'
CONTENT = r"""(?i)property=["']og:description["'][^>]+content=["'][^"']+"""


def _found(page: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(page, pattern, group), F.lit(""))


def meta_tag(page: Column, name: str) -> Column:
    """Content of a meta tag by property or name, whichever attribute comes first; null if there is none."""
    key = rf"""(?:property|name)=["']{name}["']"""
    first = _found(page, rf"""(?is)<meta[^>]+{key}[^>]+content=["']([^"']*)["']""")
    return F.coalesce(first, _found(page, rf"""(?is)<meta[^>]+content=["']([^"']*)["'][^>]+{key}"""))


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def tag_text(page: Column, tag: str) -> Column:
    """Text of the first element of a kind: tags stripped, white space collapsed; null without the element."""
    inner = F.regexp_extract(page, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    return F.nullif(squeeze(F.regexp_replace(inner, r"(?s)<[^>]*>", " ")), F.lit(""))


def _number(page: Column, pattern: str) -> Column:
    return _found(page, pattern).try_cast("bigint")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://([^/?#:]*)", 1))


def on_host(url: Column, *hosts: str) -> Column:
    """Whether the url's host is one of these or of their subdomains; of no url false."""
    found = host(url).rlike("(?:^|\\.)(?:" + "|".join(h.replace(".", "\\.") for h in hosts) + ")$")
    return F.coalesce(found, F.lit(False))


def author_titled(url: Column, hosts: tuple[str, ...] = AUTHOR_TITLE_HOSTS) -> Column:
    """Whether the page's title is its author's name there."""
    return on_host(url, *hosts)


def normal_forum_url(url: Column, forum: str = FORUM_HOST, canonical: str = FORUM_CANONICAL) -> Column:
    return F.regexp_replace(url, FORUM_PREFIXES + forum.replace(".", "\\."), f"https://{canonical}")


def scraped_posts(pages: DataFrame, page: str = "html", url: str = "url", entities: bool = True, socials: tuple[str, ...] = (SOCIAL_HOST,), forums: tuple[str, ...] = (FORUM_HOST,)) -> DataFrame:
    """Adds title, body, upvotes, num_comments, created_utc and has_content of each page. Numbers are taken where the host keeps them; other hosts have none."""
    html, at = F.col(page), F.col(url)
    decode = unescape_entities if entities else (lambda c: c)
    ms = _number(html, FORUM_TIME)
    social, forum = on_host(at, *socials), on_host(at, *forums)

    def by_host(on_social: Column, on_forum: Column) -> Column:
        return F.when(social, on_social).when(forum, on_forum)

    return pages.withColumns({
        "title": F.when(~author_titled(at), decode(F.coalesce(meta_tag(html, "og:title"), tag_text(html, "title")))),
        "body": decode(F.coalesce(meta_tag(html, "og:description"), meta_tag(html, "description"), tag_text(html, "article"))),
        "upvotes": by_host(_number(html, REACTIONS), _number(html, FORUM_SCORE)),
        "num_comments": by_host(_number(html, COMMENTS), _number(html, FORUM_COMMENTS)),
        "created_utc": by_host(_number(html, CREATED), F.when(ms > 10**12, ((ms - ms % 1000) / 1000).cast("bigint")).otherwise(ms)),
        "has_content": F.coalesce(html.rlike(CONTENT), F.lit(False)),
    })
