"""Release pages to classified, dated and valued rows; price and bar checks."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DATE = r"(?<!\d)(20\d{2})\s*[-/.年]\s*(\d{1,2})\s*[-/.月]\s*(\d{1,2})"
#: Words of movement before a percentage.
RISE, FALL, FLAT = ("增长", "上涨", "上升"), ("下降", "下跌", "减少", "回落"), ("持平",)
PERCENT = r"\s*([+-]?[\d,]+(?:\.\d+)?)\s*%"
#: What titles of releases hold, in order of precedence, what they must not hold, and the phrase that a value follows.
RELEASES = (
    ("pmi_new_orders", "中国采购经理指数运行情况", None, None),
    ("industrial_production", "规模以上工业增加值", "利润", "规模以上工业增加值"),
    ("retail_sales", "社会消费品零售总额", None, "社会消费品零售总额"),
    ("fixed_asset_investment", "固定资产投资", "房地产", r"(?:全国固定资产投资|固定资产投资（不含农户）|固定资产投资\(不含农户\))"),
    ("cpi", "居民消费价格", None, "居民消费价格"),
    ("ppi", "工业生产者出厂价格", None, "工业生产者出厂价格"),
    ("tsf_stock", "社会融资规模存量统计数据报告", None, "社会融资规模存量"),
    ("money", "金融统计数据报告", None, None),
)
#: Characters after a phrase within which its value stands.
WINDOW, CORE_WINDOW, MONEY_WINDOW, STOCK_WINDOW, DECEMBER_WINDOW, DECEMBER_VALUE_WINDOW = 280, 180, 420, 300, 300, 180


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def first_date(text: Column) -> Column:
    """First date of a text; null if it is not a date of the calendar."""
    part = [F.nullif(F.regexp_extract(text, DATE, i), F.lit("")) for i in (1, 2, 3)]
    return F.try_to_date(F.concat_ws("-", part[0], F.lpad(part[1], 2, "0"), F.lpad(part[2], 2, "0")), "yyyy-MM-dd")


#: A character reference: by number, or by name with a semicolon, or by one of the old names without it.
REFERENCE = r"&#[xX][0-9a-fA-F]{1,8};?|&#[0-9]{1,9};?|&[A-Za-z][A-Za-z0-9]*;?"


def _character(number: Column) -> Column:
    """The character of a code point; the replacement character for what is none."""
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("\ufffd")


def decoded(text: Column) -> Column:
    """Text with all character references replaced, numbers and the names of the standard; an unknown name stays as it is."""
    names = F.from_json(F.lit(json.dumps(html5)), "map<string, string>")  # folded into one constant

    def parts(t: Column) -> Column:
        return F.regexp_extract_all(t, F.lit(f"{REFERENCE}|[^&]+|&"), F.lit(0))

    def one(part: Column) -> Column:
        digits = F.regexp_replace(part, "^&#[xX]?|;$", "")
        number = F.when(part.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
        return F.when(part.rlike("^&#"), _character(number)).when(part.rlike("^&[A-Za-z]"), F.coalesce(F.try_element_at(names, F.substring(part, 2, 64)), part)).otherwise(part)

    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), F.array_join(F.transform(parts(t), one), "")).otherwise(t))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D\u00a0\u3000]+", " "))


#: What lies between the name of a tag and its end; a quoted value may hold the end's sign.
ATTRIBUTES = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"


def bare_html(html: Column) -> Column:
    """A page without comments, scripts and styles."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", "")


def visible_text(html: Column) -> Column:
    """The text of a page without comments, scripts, styles and tags."""
    return F.trim(F.regexp_replace(F.regexp_replace(bare_html(html), f"</?[A-Za-z!]{ATTRIBUTES}>", " "), r"[\x20\x09-\x0D]+", " "))


def with_class(*names: str) -> str:
    """A pattern of attributes with one of some classes."""
    name = "|".join(names)
    return rf"\bclass\s*=\s*(?:\"(?:[^\"]*\s)?(?:{name})(?:\s[^\"]*)?\"|'(?:[^']*\s)?(?:{name})(?:\s[^']*)?'|(?:{name})(?=[\s>/]))"


def with_id(name: str) -> str:
    return rf"\bid\s*=\s*(?:\"{name}\"|'{name}'|{name}(?=[\s>/]))"


def division(html: Column, attributes: str) -> Column:
    """The content of all divisions whose opening tag has attributes of a pattern, each up to the end tag where its depth returns; null without one.

    The page is cut before every tag of a division. A fold keeps depth and offset, and notes where a block begins and ends;
    so inner divisions of any depth are part of it, and the work is linear in the page. A block that is never closed runs to the end.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(1).alias("at"), F.lit(0).alias("begin"), F.array().cast("array<struct<a: int, b: int>>").alias("spans"))

    def step(state: Column, token: Column) -> Column:
        tag = F.regexp_extract(token, f"(?i)^<div\\b{ATTRIBUTES}>", 0)
        opens, closes = (tag != "") & ~tag.endswith("/>"), token.rlike("(?i)^</div")
        inside = state["depth"] > 0
        begins = opens & ~inside & tag.rlike(f"(?is){attributes}")
        ends = closes & (state["depth"] == 1)
        depth = state["depth"] + F.when(begins | (opens & inside), 1).when(closes & inside, -1).otherwise(0)
        return F.struct(
            depth.alias("depth"),
            (state["at"] + F.length(token)).alias("at"),
            F.when(begins, state["at"] + F.length(tag)).otherwise(state["begin"]).alias("begin"),
            F.when(ends, F.array_append(state["spans"], F.struct(state["begin"].alias("a"), state["at"].alias("b")))).otherwise(state["spans"]).alias("spans"),
        )

    def end(state: Column) -> Column:
        return F.when(state["depth"] > 0, F.array_append(state["spans"], F.struct(state["begin"].alias("a"), state["at"].alias("b")))).otherwise(state["spans"])

    def blocks(bare: Column) -> Column:
        spans = F.aggregate(F.split(bare, r"(?i)(?=</?div\b)"), start, step, end)
        return let(spans, lambda found: F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda s: F.substring(bare, s["a"], s["b"] - s["a"])), " ")))

    return let(bare_html(html), blocks)


def page_fields(pages: DataFrame) -> DataFrame:
    """(page_id, title, heading, n_links, text_chars)."""
    return pages.select(
        "page_id",
        F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"),
        F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1).alias("heading"),
        F.regexp_count("html", F.lit('<a href="')).alias("n_links"),
        F.length(visible_text(F.col("html"))).alias("text_chars"),
    )


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted or not; empty without it."""
    pattern = rf"(?is)[\s\"']{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])


def _named(html: Column, tag: str, name: str) -> Column:
    """The first tag of a kind with this value of ``name``."""
    return F.regexp_extract(html, rf"(?is)<{tag}\b(?=[^>]*[\s\"']name\s*=\s*[\"']?{name}[\"'\s>/]){ATTRIBUTES}>", 0)


def release_pages(pages: DataFrame) -> DataFrame:
    """(url, title, published, body, text, page_count) of pages (url, html).

    The title is the article's meta title, or else the first headings; the date the meta publication date, or else that of the title block; the
    body the article blocks with all that is nested in them.
    """
    html = F.col("html")
    heading = visible_text(F.array_join(F.regexp_extract_all(bare_html(html), F.lit(f"(?is)<h1\\b{ATTRIBUTES}>(.*?)</h1>"), F.lit(1)), " "))
    stated = F.coalesce(visible_text(division(html, with_class("detail-title-des"))), F.lit(""))
    blocks = F.coalesce(division(html, f"(?:{with_id('zoom')}|{with_class('trs_editor', 'trs_editor_view')})"), F.lit(""))
    paging = _named(html, "input", "article_paging_list_hidden")
    count = F.coalesce(F.nullif(_attribute(paging, "totalpage"), F.lit("")), _attribute(paging, "totalpages"))
    meta = F.nullif(F.trim(_attribute(_named(html, "meta", "articletitle"), "content")), F.lit(""))
    # All texts are decoded by one expression, so the plan holds the table of names once.
    raw = F.array(F.coalesce(meta, heading), _attribute(_named(html, "meta", "pubdate"), "content"), stated, visible_text(blocks), visible_text(html))
    read = pages.select("url", F.transform(raw, decoded).alias("t"), count.try_cast("int").alias("page_count"))
    text = [F.col("t")[i] for i in range(5)]
    published = F.coalesce(first_date(text[1]), first_date(text[2]))
    return read.select("url", squeezed(text[0]).alias("title"), published.alias("published"), squeezed(text[3]).alias("body"), squeezed(text[4]).alias("text"), "page_count")


def release_links(pages: DataFrame) -> DataFrame:
    """(base, href, title) of all anchors of pages (url, html): the title is their text, or else the attribute of that name."""
    found = F.regexp_extract_all(bare_html(F.col("html")), F.lit(f"(?is)<a\\b{ATTRIBUTES}>.*?</a\\s*>"), F.lit(0))
    anchors = pages.select(F.col("url").alias("base"), F.explode(found).alias("a"))
    tag = F.regexp_extract("a", f"(?i)^<a\\b{ATTRIBUTES}>", 0)
    href = F.coalesce(F.nullif(_attribute(tag, "href"), F.lit("")), F.nullif(_attribute(tag, "tagname"), F.lit("")))
    text = squeezed(decoded(visible_text(F.col("a"))))
    rows = anchors.select("base", decoded(href).alias("href"), F.coalesce(F.nullif(text, F.lit("")), decoded(_attribute(tag, "title"))).alias("title"))
    return rows.where("href is not null")


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, href, title): one row per address of a page, the longest title wins."""
    found = F.regexp_extract_all("html", F.lit('<a href="([^"]*)">([^<]*)</a>'), F.lit(0))
    links = pages.select("page_id", F.explode(found).alias("a"))
    parts = links.select("page_id", F.regexp_extract("a", '<a href="([^"]*)">', 1).alias("href"), F.regexp_extract("a", ">([^<]*)</a>", 1).alias("title"))
    return parts.groupBy("page_id", "href").agg(F.max(F.struct(F.length("title").alias("n"), "title")).alias("t")).select("page_id", "href", F.col("t.title").alias("title"))


#: An address: scheme, authority, path, query and fragment, with the signs that begin or end them.
ADDRESS = r"^([a-zA-Z][a-zA-Z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
#: Schemes whose addresses may be relative.
RELATIVE = ("http:", "https:", "ftp:", "file:")


def resolved(base: Column, href: Column) -> Column:
    """An address in full, seen from another one, by the rules of RFC 3986: a fold over the segments of both paths takes away dot segments of any depth.

    An address with another scheme or with an authority stays as it is; empty segments inside a joined path are left out.
    """
    none = F.array().cast("array<string>")

    def parsed(address: Column) -> Column:
        part = [F.regexp_extract(address, ADDRESS, i) for i in range(1, 6)]
        part[3:] = [F.regexp_replace(x, r"^[?#]$", "") for x in part[3:]]  # an empty query or fragment is none
        return F.struct(*[part[i - 1].alias(name) for i, name in enumerate(("scheme", "host", "path", "query", "fragment"), 1)])

    def flat(segments: Column) -> Column:
        """Without empty segments, but for the first and last."""
        n = F.size(segments)
        middle = F.when(n > 2, F.filter(F.slice(segments, 2, F.greatest(n - 2, F.lit(0))), lambda s: s != "")).otherwise(none)
        return F.concat(F.slice(segments, 1, 1), middle, F.when(n > 1, F.slice(segments, n, 1)).otherwise(none))

    def step(stack: Column, s: Column) -> Column:
        return F.when(s == "..", F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).when(s == ".", stack).otherwise(F.array_append(stack, s))

    def folded(segments: Column) -> Column:
        stack = F.aggregate(segments, none, step)
        ended = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(stack, F.array(F.lit("")))).otherwise(stack)
        return F.regexp_replace(F.array_join(ended, "/"), "^(?!/)", "/")

    def joined(of: Column, to: Column) -> Column:
        folder = let(F.split(of["path"], "/", -1), lambda parts: F.when(F.element_at(parts, -1) == "", parts).otherwise(F.slice(parts, 1, F.size(parts) - 1)))
        own = F.split(to["path"], "/", -1)
        return F.concat(let(F.when(to["path"].startswith("/"), own).otherwise(let(F.concat(folder, own), flat)), folded), to["query"])

    def seen(pair: Column) -> Column:
        of, to = pair["of"], pair["to"]
        scheme = F.lower(of["scheme"])
        foreign = (to["scheme"] != "") & (F.lower(to["scheme"]) != scheme) | ~scheme.isin(*RELATIVE)
        same = F.concat(of["path"], F.when(to["query"] == "", of["query"]).otherwise(to["query"]))
        rest = F.when(to["host"] != "", F.concat(to["host"], to["path"], to["query"])).otherwise(F.concat(of["host"], F.when(to["path"] == "", same).otherwise(joined(of, to))))
        return F.when(pair["href"] == "", pair["base"]).when(foreign, pair["href"]).otherwise(F.concat(scheme, rest, to["fragment"]))

    href = F.trim(href)
    return let(F.struct(base.alias("base"), href.alias("href"), parsed(base).alias("of"), parsed(href).alias("to")), seen)


def candidate_links(links: DataFrame, prefix: str, first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """(url, title) of links (base, href, title) whose full address has a path under ``prefix`` and, if years are given, whose title names one of them; the longest title of an address wins."""
    rows = links.where(F.trim("title") != "").withColumn("url", resolved(F.col("base"), F.col("href")))
    rows = rows.where(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1).startswith(prefix), F.lit(False)))
    if first_year is not None:
        rows = rows.where(F.regexp_extract("title", r"(?<!\d)(20\d{2})年", 1).try_cast("int").between(first_year, last_year))
    return rows.groupBy("url").agg(F.max(F.struct(F.length(F.trim("title")).alias("n"), F.trim("title").alias("title"))).alias("t")).select("url", F.col("t.title").alias("title"))


def release_class(title: Column) -> Column:
    """The series that a release's title announces; null for another title."""
    out = F.lit(None).cast("string")
    for name, words, never, _ in reversed(RELEASES):
        fits = title.contains(words) & (~title.contains(never) if never else F.lit(True))
        out = F.when(fits, name).otherwise(out)
    return out


def _year(title: Column) -> Column:
    return F.nullif(F.regexp_extract(title, r"(?<!\d)(20\d{2})年", 1), F.lit(""))


def period_months(title: Column) -> tuple[Column, Column, Column]:
    """(year, first month, last month) as text that a title names; null where it names none.

    Months 1 to n jointly, the first three quarters, a first quarter, a first half, a month, or December for an annual money report.
    """
    year = _year(title)
    rest = F.regexp_extract(title, r"(?<!\d)20\d{2}年(.*)$", 1)
    joint = r"(\d{1,2})\s*[—–－-]\s*(\d{1,2})月"
    begins, ends = F.regexp_extract(rest, joint, 1).try_cast("int"), F.regexp_extract(rest, joint, 2).try_cast("int")
    is_joint = (begins == 1) & ends.between(1, 12)
    named = F.when(rest.rlike("前三季度|前三季"), 9).when(rest.contains("一季度"), 3).when(rest.contains("上半年"), 6)
    month = F.regexp_extract(rest, r"(\d{1,2})月", 1).try_cast("int")
    single = F.coalesce(named, month, F.when(rest.contains("金融统计数据报告"), 12))
    last = F.when(F.coalesce(is_joint, F.lit(False)), ends).otherwise(F.when(single.between(1, 12), single))
    return year, F.when(F.coalesce(is_joint, F.lit(False)), F.lit(1)).otherwise(last), last


def _month_end(year: Column, month: Column) -> Column:
    return F.last_day(F.try_to_date(F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lit("01")), "yyyy-MM-dd"))


def release_period(title: Column) -> Column:
    """Last day of the period that a title names; an annual report on the stock of social financing is December's."""
    year, _, last = period_months(title)
    annual = F.when(title.rlike("20\\d{2}年社会融资规模存量统计数据报告"), 12)
    month = F.coalesce(last, annual)
    return F.when(year.isNotNull() & month.isNotNull(), _month_end(year, month))


def signed_percent(text: Column, phrase: str | None = None, window: int = WINDOW, also: tuple[str, ...] = ()) -> Column:
    """The first percentage after a word of movement, within ``window`` characters of a phrase's end if one is given: negative after a fall, 0 for unchanged."""
    tail = text if phrase is None else F.regexp_extract(text, rf"(?s){phrase}(.{{0,{window}}})", 1)
    pattern = f"({'|'.join((*RISE, *also, *FALL, *FLAT))}){PERCENT}"

    def signed(found: Column) -> Column:
        word, number = found["word"], found["number"]
        return F.when(word.isin(*FLAT), 0.0).when(word.isin(*FALL), -F.abs(number)).when(word != "", number)

    number = F.regexp_replace(F.regexp_extract(tail, pattern, 2), ",", "").try_cast("double")
    return let(F.struct(F.regexp_extract(tail, pattern, 1).alias("word"), number.alias("number")), signed)


def release_values(pages: DataFrame) -> DataFrame:
    """(url, series, title, published, observation_date, observation_period, value) of release pages (url, title, published, body); value is null where none is found.

    A page on consumer prices has a row for core prices if it states them, one on money a row for M1 and M2. Retail sales of joint or
    cumulative periods are a series of their own; an annual retail release counts for December, with December's value.
    """
    title, body = F.col("title"), F.col("body")
    kind = release_class(title)
    year, first, last = period_months(title)
    december = F.when(kind == "fixed_asset_investment", 12).when((kind == "retail_sales") & body.rlike(r"12\s*月份"), 12).when((kind == "tsf_stock") & title.rlike("20\\d{2}年社会融资规模存量统计数据报告"), 12)
    rows = pages.withColumn("kind", kind).withColumn("year", year).withColumn("annual", last.isNull() & december.isNotNull())
    rows = rows.withColumn("last", F.coalesce(last, december)).withColumn("first", F.coalesce(first, december)).where("kind is not null and year is not null and last is not null")
    joint = F.col("first") < F.col("last")
    series = F.when((F.col("kind") == "retail_sales") & joint, "retail_sales_ytd").otherwise(F.col("kind"))
    month = F.concat_ws("-", "year", F.lpad(F.col("last").cast("string"), 2, "0"))
    period = F.when(joint, F.concat(F.col("year"), F.lit("-01/"), month)).otherwise(month)
    value = F.lit(None).cast("double")
    for name, _, _, phrase in RELEASES:
        if phrase and name != "tsf_stock":
            value = F.when(F.col("kind") == name, F.coalesce(signed_percent(body, phrase), signed_percent(title, phrase, 1000))).otherwise(value)
    value = F.when(F.col("kind") == "tsf_stock", signed_percent(body, "社会融资规模存量", STOCK_WINDOW)).otherwise(value)
    orders = F.regexp_extract(body, r"新订单指数\s*(?:为|是|：|:)?\s*(\d+(?:\.\d+)?)\s*%?", 1).try_cast("double")
    value = F.when(F.col("kind") == "pmi_new_orders", orders).otherwise(value)
    in_december = F.regexp_extract(body, rf"(?s)12\s*月份(.{{0,{DECEMBER_WINDOW}}})", 1)
    value = F.when(F.col("annual") & (F.col("kind") == "retail_sales"), signed_percent(in_december, "社会消费品零售总额", DECEMBER_VALUE_WINDOW)).otherwise(value)
    cells = [F.struct(series.alias("series"), value.alias("value"))]
    core = signed_percent(body, r"核心\s*(?i:CPI)(?:指数)?", CORE_WINDOW)
    cpi = F.array(*cells, F.struct(F.lit("core_cpi").alias("series"), core.alias("value")))
    aggregate = [F.struct(F.lit(f"m{n}").alias("series"), signed_percent(F.regexp_extract(body, rf"(?s)[Mm]\s*[_{{（(]?\s*{n}\s*[}}）)]?(.{{0,{MONEY_WINDOW}}})", 1), also=("增加",)).alias("value")) for n in (1, 2)]
    found = F.when(F.col("kind") == "money", F.array(*aggregate)).when((F.col("kind") == "cpi") & core.isNotNull(), cpi).otherwise(F.array(*cells))
    out = rows.withColumn("period", period).withColumn("end", _month_end(F.col("year"), F.col("last"))).select("url", "title", "published", F.col("end").alias("observation_date"), F.col("period").alias("observation_period"), F.explode(found).alias("c"))
    return out.select("url", "c.series", "title", "published", "observation_date", "observation_period", "c.value")


def snapshot_rows(values: DataFrame) -> DataFrame:
    """Observations of valued releases: official where the page is dated, with the page as evidence, of unknown date otherwise."""
    dated = F.col("published").isNotNull()
    return values.where("value is not null").select(
        F.col("series").alias("series_id"),
        "observation_date",
        "observation_period",
        F.col("published").alias("available_date"),
        F.when(dated, "official_release").otherwise("unknown").alias("availability_basis"),
        F.when(dated, F.col("url")).otherwise("").alias("availability_evidence_url"),
        F.col("url").alias("source_value_url"),
        "value",
        F.col("title").alias("source_title"),
    )


def page_values(pages: DataFrame) -> DataFrame:
    """``release_values`` of pages (url, html); a page without an article block is read as a whole."""
    return release_values(release_pages(pages).withColumn("body", F.coalesce(F.nullif("body", F.lit("")), "text")))


def harvest(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages (url, html) to snapshot rows, the releases whose value was not found, and coverage by series."""
    values = page_values(pages)
    rows = snapshot_rows(values)
    return rows, values.where("value is null").select("series", "title", "url"), harvest_coverage(rows)


def harvest_coverage(rows: DataFrame) -> DataFrame:
    """Per series: distinct observations, first and last, and rows with and without a release date."""
    return rows.groupBy("series_id").agg(
        F.count_distinct("observation_date").alias("observations"),
        F.min("observation_date").alias("first_date"),
        F.max("observation_date").alias("last_date"),
        F.count("available_date").alias("dated"),
        F.count(F.when(F.col("available_date").isNull(), 1)).alias("undated"),
    )


def completed_month_close(bars: DataFrame) -> DataFrame:
    """(symbol, date, close): last close of each month but the newest, which may be unfinished."""
    by = bars.groupBy("symbol", F.date_trunc("month", "date").cast("date").alias("month")).agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))
    return by.withColumn("newest", F.max("month").over(Window.partitionBy("symbol"))).where("month < newest").select("symbol", "date", "close")


def estimated_closes(closes: DataFrame) -> DataFrame:
    """Closes as observations that are taken to be known a day later."""
    return closes.select(F.col("symbol").alias("series_id"), F.col("date").alias("observation_date"), F.col("close").alias("value"), F.date_add("date", 1).alias("available_date"), F.lit("fixed_lag").alias("availability_basis"))


def ohlc_checks(bars: DataFrame) -> DataFrame:
    """(symbol, n, bad_price, high_below_low, duplicates)."""
    bad = ~F.coalesce(F.least("open", "high", "low", "close") > 0, F.lit(False))
    by = bars.groupBy("symbol").agg(F.count("*").alias("n"), F.count(F.when(bad, 1)).alias("bad_price"), F.count(F.when(F.col("high") < F.col("low"), 1)).alias("high_below_low"), F.count_distinct("date").alias("dates"))
    return by.withColumn("duplicates", F.col("n") - F.col("dates")).drop("dates")


#: The columns of a bar file.
BAR_COLUMNS = ("DATE", "OPEN", "HIGH", "LOW", "CLOSE")


def bar_date(text: Column) -> Column:
    """A date written M/D/Y or as ISO text; null otherwise."""
    return F.coalesce(F.try_to_date(text, "M/d/yyyy"), F.try_to_date(text, "yyyy-MM-dd"))


def validate_ohlc(raw: DataFrame, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Typed bars of text columns DATE, OPEN, HIGH, LOW, CLOSE, and (rule, at) of what is wrong with them.

    Rules: another header, a date of neither format or twice, a price that is no positive number, a high below its low, fewer than ``least`` rows.
    """
    if tuple(raw.columns) != BAR_COLUMNS:
        raise ValueError(f"bars have the columns {raw.columns}, not {list(BAR_COLUMNS)}")
    price = "decimal(18,6)"
    bars = raw.select(F.col("DATE").alias("at"), bar_date(F.trim("DATE")).alias("date"), *[F.trim(c).try_cast(price).alias(c.lower()) for c in BAR_COLUMNS[1:]])
    prices = [F.col(c.lower()) for c in BAR_COLUMNS[1:]]
    rules = {"bad_date": F.col("date").isNull(), "bad_price": ~F.coalesce(F.least(*prices) > 0, F.lit(False)) | F.greatest(*[p.isNull() for p in prices]), "high_below_low": F.col("high") < F.col("low")}
    rows = bars.select(F.explode(F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in rules.items()]))).alias("rule"), "at")
    twice = bars.where("date is not null").groupBy("date").count().where("count > 1").select(F.lit("duplicate_date").alias("rule"), F.col("date").cast("string").alias("at"))
    short = bars.agg(F.count("*").alias("n")).where(F.col("n") < least).select(F.lit("too_few_rows").alias("rule"), F.col("n").cast("string").alias("at"))
    return bars.drop("at"), rows.unionByName(twice).unionByName(short)


def select_close(bars: DataFrame, field: str = "Close", strict: bool = False) -> DataFrame:
    """(symbol, date, price) of a vendor's long table (field, ticker, time, value): one field, dates without their zone. ``strict``: a table without a price is an error; one row is read for it."""
    out = bars.where(F.col("field") == field).where("value is not null").select(F.col("ticker").alias("symbol"), F.col("time").cast("date").alias("date"), F.col("value").cast("double").alias("price"))
    if strict and out.isEmpty():
        raise ValueError(f"no row has a value of {field}")
    return out


def price_status(prices: DataFrame) -> DataFrame:
    """(symbol, n, first_date, last_date, least, most)."""
    return prices.groupBy("symbol").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.min("price").alias("least"), F.max("price").alias("most"))


def price_report(prices: DataFrame, configured: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """Every configured or present symbol: start, end, observations, a quality class, and the hash of its file where an inventory (symbol, sha256) is given.

    Quality: missing without prices, invalid with a price that is not positive or a date twice, present_not_configured, or ok.
    """
    by = prices.groupBy("symbol").agg(
        F.count("*").alias("n"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        (F.count("*") - F.count_distinct("date") + F.count(F.when(~F.coalesce(F.col("price") > 0, F.lit(False)), 1))).alias("faults"),
    )
    wanted = configured.select(F.upper(F.trim("symbol")).alias("symbol"), F.lit(True).alias("configured")).distinct()
    out = wanted.join(by, "symbol", "full")
    quality = F.when(F.col("n").isNull(), "missing").when(F.col("faults") > 0, "invalid").when(F.col("configured").isNull(), "present_not_configured").otherwise("ok")
    out = out.select("symbol", "first_date", "last_date", F.coalesce("n", F.lit(0)).alias("n"), quality.alias("quality"))
    return out if inventory is None else out.join(inventory.select("symbol", "sha256"), "symbol", "left")
