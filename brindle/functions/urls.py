"""Addresses of listings. All are Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_key(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), "/+$", ""))


def url_host(url: Column) -> Column:
    """Host without www., empty if there is none."""
    return F.regexp_extract(F.lower(url), r"^https?://(?:www\.)?([^/]+)", 1)


def url_rank(url: Column) -> Column:
    """Fitness as the link to click, lower is better: page 10, social event 20, social page 30, share wrapper 40, none 100."""
    low, host = F.lower(url), url_host(url)
    return (
        F.when(F.coalesce(url, F.lit("")) == "", 100).when(low.rlike(r"facebook\.com/(?:events/s/|share/)|fb\.me/"), 40)
        .when(host.contains("facebook.com") | host.contains("fb.com"), F.when(low.contains("/events/"), 20).otherwise(30))
        .when(host.contains("instagram.com"), 30).otherwise(10)
    )


def classify_url(url: Column) -> Column:
    """How a link can be verified."""
    low, host = F.lower(url), F.regexp_extract(F.lower(url), r"^https?://([^/:?#]+)", 1)
    return (
        F.when(F.coalesce(url, F.lit("")) == "", "no_url")
        .when(host.contains("facebook.com") | host.contains("fb.com"), F.when(low.contains("/events/") | low.contains("/events?"), "facebook_event").otherwise("facebook_page"))
        .when(host.contains("instagram.com"), "instagram").when(host.contains("eventbrite.com"), "eventbrite")
        .when(host.isin("twitter.com", "x.com", "www.twitter.com", "www.x.com"), "social").otherwise("direct")
    )


def link_verdict(url: Column, status: Column, title: Column, og_title: Column, error: Column) -> Column:
    """ok, broken or unverifiable, by host, status, error and the page's titles."""
    host = url_host(url)
    instagram, facebook = host.contains("instagram.com"), host.contains("facebook.com") | host.contains("fb.com")
    untold = F.lower(F.trim(F.coalesce(title, F.lit("")))).isin("", "facebook", "log in or sign up to view", "log into facebook")
    unsure, broken, ok = F.lit("unverifiable"), F.lit("broken"), F.lit("ok")
    general = (
        F.when(status.isNull(), unsure).when(status.isin(404, 410), broken).when(status >= 500, unsure).when(status.isin(401, 403, 429), unsure).when(status >= 400, broken).otherwise(ok)
    )
    social = (
        F.when(status == 404, broken).when(status == 400, unsure).when(status >= 500, unsure)
        .when(untold, F.when(F.lower(url).rlike("/events/s/|/share/"), broken).otherwise(unsure)).otherwise(ok)
    )
    photos = F.when(status == 404, broken).when(status >= 500, unsure).when(status.isin(401, 403, 429), unsure).when(F.coalesce(og_title, F.lit("")) != "", ok).otherwise(broken)
    return (
        F.when(F.coalesce(url, F.lit("")) == "", unsure).when(error.isNotNull() & status.isNull(), F.when(error.isin("ConnectionError", "SSLError"), broken).otherwise(unsure))
        .when(instagram, photos).when(facebook, social).otherwise(general)
    )
