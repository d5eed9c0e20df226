"""The page table with extra markup chosen by page_id.

The given pages have no forms, images, social tags or listing words. Every operator that looks for
those is exercised on this table instead; it has one row per given page and keeps the whole page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftpage.sources.tables import pages

# (divisor, remainder, markup put before </head>)
HEAD = (
    (5, 1, '<meta property="og:type" content="product">'),
    (5, 2, '<meta property="og:type" content="Article">'),
    (5, 3, '<meta property="og:type" content="video.other">'),
    (7, 0, '<link rel="alternate" type="application/rss+xml" href="/feed.xml">'),
    (11, 0, '<meta name="twitter:card" content="player">'),
    (11, 5, '<meta name="twitter:card" content="summary_large_image">'),
    (13, 1, '<script type="application/ld+json">{"@type":"Recipe","author":{"@type":"Person"}}</script>'),
    (2, 0, '<link rel="canonical" href="/canonical">'),
    (19, 0, '<meta name="robots" content="noindex, follow">'),
    (9, 0, '<link rel="next" href="?page=3"><link rel="prev" href="?page=1">'),
    (14, 5, '<base href="/"><meta property="og:type" content="business.place">'),
    (3, 1, '<meta name="description" content="first"><meta name="description" content="second">'),
    (16, 9, '<!-- <script type="application/ld+json">{"@type":"Event"}</script> -->'),
)
# (divisor, remainder, markup put before </article>)
BODY = (
    (13, 0, '<div itemscope itemtype="https://schema.org/Product/"><span>Widget</span></div>'),
    (
        3, 0,
        '<div class="filter panel" id="filters"><p>Showing 24 results</p></div>'
        '<div class="pagination" aria-label="Pagination"><a href="?page=1">1</a>'
        '<a href="?page=2&amp;x=1">2</a><a href="?page=3">next page</a></div>'
        '<div class="grid"><div class="result-item card">one</div>'
        '<div class="result-item card">two</div><div class="result-item card">three</div>'
        '<div class="result-item card">four</div><div class="result-item card">five</div></div>',
    ),
    (
        4, 1,
        '<form action="/find" method="POST"><input type="search" name="q" placeholder="Search here">'
        '<input type="password" name="p" required><select name="s"><option>a<option>b</select>'
        '<input type="checkbox" name="c1"><input type="checkbox" name="c2">'
        '<input type="checkbox" name="c3"><input type="range" name="r"><button>Go</button></form>'
        '<ul role="tablist" class="tab bar"><li>one<li>two<li>three<li>four<li>five<li>two</ul>',
    ),
    (
        4, 2,
        '<figure><img src="a.png" alt="first" class="gallery"><img src="b.png" alt="">'
        '<img data-src="c.png" class="gallery" alt="third"><img class="gallery thumb" src="">'
        '<figcaption>Four pictures</figcaption></figure><iframe src="/v"></iframe>',
    ),
    (
        4, 3,
        '<section class="specs"><h2>Specification</h2><p>Price: $1,299.00 or 99 &quot;EUR&quot;, add '
        'to cart. Rated 4.5 out of 5 stars, 12 reviews.</p><table><tr><td>a<td>b<td>c<td>d'
        '<tr><td>e<td>f<td>g<td>h</table><p>By John Smith, published on March 5, 2023. Share this, '
        'comment below, related items. 1,200 views.</p><time datetime="2023-03-05">Mar 5</time>'
        '</section>',
    ),
    (
        6, 5,
        '<div class="hero banner"><h3>Pricing plans</h3><p>Privacy policy, terms of service, about us, '
        'contact us and faq. Get started, sign up, try for free, learn more. Our enterprise platform '
        'for teams has a free trial, no credit card needed. What is it? How can I start?</p></div>',
    ),
    (
        8, 3,
        '<ol class="breadcrumb"><li><a href="/">home</a><li><a href="/x">x</a><li><span>y</span></ol>'
        '<div class="list"><article>one</article><article>two</article><article>three</article>'
        '<article>four</article></div><a href="#a">a</a><a href="#b">b</a><a href="#c">c</a>'
        '<a href="https://other.example.org/z">out</a><a href="//cdn.example.org/y">out too</a>'
        '<a href="/The">again</a>',
    ),
    (
        9, 4,
        '<p>Apply now. Salary and responsibilities. 25 jobs found, full-time or remote roles. Sort by '
        'date. Latest jobs. Application deadline is 01/02/2024. Member since 2020, posts: 12, reply.'
        '</p>',
    ),
    (
        10, 7,
        '<p>Discover all events. Upcoming events in 2019, 2020, 2021, 2022 and 2023: 14 events. Venue, '
        'speaker and lineup. Register. Publications and papers, table of contents. Established est.1990 '
        '(contact, phone). Duration: 90</p>',
    ),
    (
        14, 2,
        '<main><header>Top</header><aside class="toc">Contents</aside><h4>Notes</h4><div>This block of the '
        'main part has rather more than fifty characters of text.</div><p>Written by Jane Roe, updated in '
        'May 2021, with many more words so that the paragraph is rich.</p></main>',
    ),
)
# (divisor, remainder, markup put before </article> as well): code in comments and attribute values
HIDDEN_CODE = (
    (11, 1, '<!-- <script> old --><p>Visible one</p><script>x</script><p>two</p>'),
    (11, 2, '<p>A</p><!-- <noscript> --><p>kept text</p>'),
    (11, 3, '<p title="<style>">attr</p><p>after</p>'),
    (11, 4, '<!-- <div><style>p{}</style><p>gone</p></div> --><noscript><p>off</p></noscript><p>on</p>'),
)
# as well: words of error pages in scripts and prose, which make no error page, and where they make one
NOTICES = (
    (15, 4, '<script>var k="captcha";</script><p>Smoking is forbidden here; access denied is a phrase.</p>'),
    (25, 7, '<h2>Access denied</h2>'),
    (27, 2, '<form id="challenge-form" action="/verify"><input name="answer"></form>'),
)
BODY += HIDDEN_CODE + NOTICES
# (divisor, remainder, text put before </footer>)
FOOTER = (
    (12, 1, ' About us contact privacy terms help support careers'),
    (12, 5, ' Legal help'),
)
# (divisor, remainder, title)
TITLES = (
    (17, 0, '404 page not found'),
    (17, 3, 'How to search all products (24)? A guide'),
)
# (divisor, remainder, URL)
URLS = (
    (23, 1, 'https://boards.greenhouse.io/acme/jobs/1234567/apply'),
    (23, 2, 'https://en.wikipedia.org/wiki/Spark_(software)'),
    (23, 3, 'https://example.com/'),
    (23, 4, 'http://user@shop.example.com:8080/category/long-blue-shirt/12345?q=1&sort=asc&page=2'),
    (23, 5, 'https://arxiv.org/list/cs.DB/recent'),
    (23, 6, 'https://docs.python.org/3/library/re.html'),
    (23, 7, 'https://vimeo.com/categories/music'),
    (23, 8, 'https://museum.example.org/exhibitions/'),
    (23, 9, 'https://example.edu/search/results?type=paper'),
    (23, 10, 'https://example.com/about/;x=1#frag'),
    (23, 11, 'https://example.com/forum/thread/some-topic-here/post/77'),
    (23, 12, 'https://example.com/en-us'),
    (23, 13, 'https://en.wikipedia.org/wiki/Talk:Spark/Archive'),
    (23, 14, 'https://jobs.lever.co/acme/0a1b'),
    (23, 15, 'https://example.com/news/2024/article/watch?v=abc'),
)


def _chosen(rules, otherwise):
    out = otherwise
    for divisor, rest, value in rules:
        out = F.when(F.col("page_id") % divisor == rest, F.lit(value)).otherwise(out)
    return out


def decorate(plain: DataFrame) -> DataFrame:
    def extra(rules):
        return F.concat(
            *[
                F.when(F.col("page_id") % divisor == rest, F.lit(markup)).otherwise("")
                for divisor, rest, markup in rules
            ]
        )

    html = F.col("html")
    for rules, mark in ((HEAD, "</head>"), (BODY, "</article>"), (FOOTER, "</footer>")):
        html = F.replace(html, F.lit(mark), F.concat(extra(rules), F.lit(mark)))
    title = _chosen(TITLES, F.lit(None).cast("string"))
    titled = F.regexp_replace(
        html, F.lit("<title>[^<]*</title>"), F.concat(F.lit("<title>"), title, F.lit("</title>"))
    )
    return with_urls(plain).withColumn("html", F.coalesce(titled, html))


def with_urls(df: DataFrame) -> DataFrame:
    return df.withColumn("url", _chosen(URLS, F.col("url")))


def decorated_pages(spark: SparkSession, folder: str) -> DataFrame:
    return decorate(pages(spark, folder))
