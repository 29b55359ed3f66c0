"""Column builders for video links: predicate, normal form, id, search text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted hosts, and words that tell a query for music.
HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "youtu.be", "www.youtu.be")
SONG_WORDS = ("song", "songs", "music", "track", "tracks", "audio", "official")
ID = r"^[A-Za-z0-9_-]{6,20}$"
PATHS = ("shorts", "embed", "live")


def with_scheme(url: Column) -> Column:
    u = F.trim(url)
    return F.when(u.contains("://"), u).otherwise(F.concat(F.lit("https://"), u))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(with_scheme(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def is_allowed(url: Column, hosts: tuple[str, ...] = HOSTS) -> Column:
    """An http(s) or scheme-less link to one of the hosts, with a path; false for null and empty."""
    starts = F.lower(F.trim(url)).rlike("^(https?://)?(" + "|".join(h.replace(".", "\\.") for h in sorted(hosts, key=len, reverse=True)) + ")/")
    return F.coalesce(starts & host(url).isin(*hosts), F.lit(False))


def normal_form(url: Column, hosts: tuple[str, ...] = HOSTS) -> Column:
    """Trimmed, with a scheme; null where the link is not allowed."""
    u = F.trim(url)
    return F.when(is_allowed(url, hosts), F.when(u.startswith("http"), u).otherwise(F.concat(F.lit("https://"), u)))


def video_id(url: Column, hosts: tuple[str, ...] = HOSTS, short_hosts: tuple[str, ...] = ("youtu.be", "www.youtu.be")) -> Column:
    """The id in a short link's path, a query's v, or after shorts, embed or live; null if there is none or it is malformed."""
    u = normal_form(url, hosts)
    path = F.regexp_extract(u, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    first = F.regexp_extract(path, r"^/+([^/]*)", 1)
    in_query = F.regexp_extract(u, r"^[^?#]*\?(?:[^#]*&)?v=([^&#]+)", 1)
    after = F.regexp_extract(path, r"^/+(?:" + "|".join(PATHS) + r")/+([^/]+)", 1)
    found = F.when(host(u).isin(*short_hosts), first).when(in_query != "", in_query).otherwise(after)
    return F.when(found.rlike(ID), found)


def search_text(query: Column) -> Column:
    """The query with " songs" behind it unless it has a word of music."""
    q = F.trim(query)
    return F.when(F.lower(q).rlike("|".join(SONG_WORDS)), q).otherwise(F.concat(q, F.lit(" songs")))


def is_job_id(key: Column) -> Column:
    return F.coalesce(key.rlike("^[a-f0-9]{12}$"), F.lit(False))
