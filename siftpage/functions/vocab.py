"""The word lists, patterns and limits the classifier is defined by.

They must stay as they are for results to be right. Whole-word lists hold single-spaced phrases;
names ending in _PATTERN are regular expressions over the folded lower-case text.
"""

# ---- limits -------------------------------------------------------------------------------
MIN_TEXT_LENGTH = 100
CLASSES = ("detail", "list", "others")

# ---- cue phrases, tested as substrings ----------------------------------------------------
LIST_CUES = (
    "results", "listings", "search", "browse", "catalog", "catalogue",
    "index", "directory", "archive", "collection", "products", "items",
    "articles", "posts", "jobs", "properties", "recipes", "hotels",
    "filter", "sort", "showing", "found", "per page", "load more",
    "next page", "previous", "pagination", "view all", "see all",
    "compare", "grid", "list view", "refine",
)
DETAIL_CUES = (
    "description", "overview", "specification", "specifications", "details",
    "about", "summary", "biography", "profile", "review", "reviews",
    "rating", "price", "buy", "add to cart", "purchase", "order",
    "in stock", "availability", "published", "author", "posted",
    "last updated", "share", "comment", "reply", "related",
    "table of contents", "introduction", "conclusion", "references",
    "ingredients", "instructions", "how to", "step", "method",
    "salary", "experience", "requirements", "responsibilities",
)
BOILERPLATE = (
    "privacy policy", "terms of service", "cookie policy", "all rights reserved",
    "contact us", "about us", "sign in", "log in", "sign up", "register",
    "subscribe", "follow us", "share this", "skip to content", "back to top",
    "home", "sitemap", "help center", "faq", "advertise", "careers",
)
TITLE_LIST_WORDS = (
    "results", "search", "browse", "catalog", "category", "directory",
    "listings", "products", "jobs", "hotels", "properties", "recipes",
    "articles", "all", "find", "explore", "shop", "store",
)
TITLE_DETAIL_WORDS = (
    "review", "guide", "how to", "what is", "about", "profile",
    "price", "specification", "overview", "tutorial", "introduction",
)

# ---- schema.org types ---------------------------------------------------------------------
LIST_TYPES = (
    "searchresultspage", "itemlist", "collectionpage", "productcollection",
    "offerscatalog", "breadcrumblist",
)
DETAIL_TYPES = (
    "product", "article", "newsarticle", "blogposting", "recipe",
    "jobposting", "event", "movie", "book", "person", "organization",
    "hotel", "restaurant", "localbusiness", "medicalcondition",
    "howto", "faqpage", "profilepage",
)
HINT_LIST_TYPES = LIST_TYPES + ("dataset", "datafeed")
HINT_DETAIL_TYPES = (
    "product", "productgroup", "article", "newsarticle", "blogposting",
    "recipe", "jobposting", "event", "movie", "book", "person", "organization",
    "localbusiness", "hotel", "restaurant", "howto", "faqpage", "profilepage",
    "videoobject", "podcastepisode", "course", "vehicle", "softwareapplication",
)
RULE_DETAIL_TYPES = (
    "product", "productgroup", "offer", "newsarticle", "blogposting", "technicalarticle",
    "scholarlyarticle", "recipe", "jobposting", "event", "movieseries", "movie", "tvseries",
    "tvepisode", "book", "musicrecording", "musicalbum", "podcast", "podcastepisode",
    "realestate", "apartment", "house", "medicalcondition", "drug", "howto", "faqpage",
    "qapage", "softwareapplication", "videoobject", "course", "vehicle", "automobile",
)
RULE_LIST_TYPES = (
    "searchresultspage", "itemlist", "collectionpage", "productcollection", "offerscatalog",
    "dataset", "datafeed",
)

# ---- Open Graph ---------------------------------------------------------------------------
OG_PLAIN = ("website", "webpage", "")
OG_CONTENT_PREFIXES = ("article", "video.", "music.", "product", "profile", "book")
OG_RULE_PREFIXES = (
    ("video.", "detail"), ("music.", "detail"), ("book", "detail"), ("product", "detail"),
    ("profile", "detail"), ("restaurant", "detail"), ("business.", "detail"),
    ("itemlist", "list"),
)

# ---- markup -------------------------------------------------------------------------------
COUNTED_TAGS = (
    "div", "section", "article", "ul", "ol", "li", "table", "tr", "td", "span", "p",
    "h1", "h2", "h3", "h4", "aside", "nav", "header", "footer", "main",
)
SIBLING_CONTAINERS = ("ul", "ol", "div", "section")
GRID_CLASS = (
    r"\b(product[-_]?item|result[-_]?item|listing[-_]?item|job[-_]?item|post[-_]?item|"
    r"item[-_]?card|product[-_]?card)\b"
)
RULE_GRID_CLASS = (
    r"\b(product[-_]?(?:item|card|tile)|result[-_]?item|listing[-_]?item|job[-_]?item|"
    r"card[-_]?item)\b"
)
GALLERY_CLASS = r"\b(gallery|carousel|slider|swiper|thumbnail|thumb|product[-_]?image)\b"
FILTER_CLASS = r"\b(filter|facet|refine|sort[-_]by|sort\s+by)\b"
CARD_CLASS = r"\b(card|item|tile|product|listing|result)\b"
SPEC_CLASS = (
    r"\b(specification|spec|features?|dimensions?|weight|material|compatibility|requirements?|"
    r"ingredient)\b"
)
TOC_PATTERN = r"table\s+of\s+contents|toc|contents"
HERO_CLASS = r"\b(hero|banner|jumbotron|masthead|splash)\b"

# ---- URL words ----------------------------------------------------------------------------
URL_LIST_TOKENS = (
    "search", "results", "catalog", "category", "categories",
    "products", "listings", "browse", "index", "archive",
    "tag", "tags", "shop", "store", "jobs", "properties",
    "hotels", "recipes", "articles", "news", "blog",
)
URL_DETAIL_TOKENS = (
    "product", "item", "article", "post", "property",
    "job", "hotel", "recipe", "profile", "detail",
    "view", "show", "read", "watch", "event",
)
URL_SEARCH_PARAMS = ("q", "query", "search", "keyword", "s", "find")
URL_FILTER_PARAMS = ("filter", "sort", "order", "page", "offset", "limit", "from")
URL_JOB_HOSTS = (
    "lever.co", "greenhouse.io", "workable.com", "smartrecruiters.com",
    "applytojob.com", "bamboohr.com", "jobs.lever.co", "boards.greenhouse.io",
)
URL_API_HOSTS = (
    "docs.python.org", "developer.mozilla.org", "docs.aws.amazon.com",
    "github.com/docs", "official-docs",
)
SINGLE_ITEM_URL = (
    r"(\?v=|&v=|/watch\b|/item/|/dp/|/product/|/p/[a-zA-Z0-9_-]+|"
    r"/post/|/article/|/news/|/story/|/job/|/event/|/recipe/|/listing/|/shorts/)"
)
LISTING_SEARCH_QUERY = r"(^|&)(q|query|search|s|find|keyword|term|k|field-keywords)="
LISTING_FILTER_QUERY = r"(^|&)(type|category|filter|sort|page|offset|c)="
LISTING_PATH = (
    r"/(search|results?|listings?|categories|category|browse|discover|explore|publications?|"
    r"exhibitions?|datasets?|topics?|tags?|genre|archive|year|list[/-])/?"
)
LISTING_PATH_END = (
    r"/(jobs|careers|vacancies|openings|products|items|hotels|recipes|articles|posts|news|"
    r"papers?|reports?)/?$"
)
LISTING_HOST = (
    r"(boards\.|jobs\.|careers\.)(greenhouse\.io|lever\.co|workable\.com|smartrecruiters\.com)"
)
BROWSE_PATH = (
    r"/(categories|category|discover|browse|explore|exhibitions?|collections?|shows?|events?|"
    r"archive|publications?|highlights?|featured)/?$"
)
RULE_BROWSE_PATH = (
    r"(?i)/(categories|category|discover|exhibitions?|browse|collections?|explore|shows?|"
    r"events?|publications?|archives?)/?$"
)
ROOT_PATHS = ("", "home", "index", "index.html", "index.htm", "en", "us", "en-us")
OTHERS_PATH = (
    r"/(about|contact|faq|help|support|privacy|terms|legal|careers|team|press|sitemap|login|"
    r"signup|register|account|settings|dashboard)/"
)

# ---- whole-word phrases in the page text --------------------------------------------------
BUY_WORDS = (
    "add to cart", "buy now", "add to bag", "purchase", "order now", "book now", "apply now",
    "get started", "download now",
)
CART_WORDS = ("add to cart", "buy now", "add to bag", "order now")
AUTHOR_WORDS = ("by", "author", "written by", "posted by", "reviewed by")
RATING_WORDS = ("star", "stars", "rating", "review", "reviews")
SHARE_WORDS = ("share", "tweet", "facebook", "linkedin", "whatsapp")
COMMENT_WORDS = ("comment", "reply", "discussion", "disqus", "livefyre")
RELATED_WORDS = ("related", "similar", "you may also", "recommended", "people also")
CONTACT_WORDS = ("address", "phone", "email", "website", "opening hours", "contact")
STORY_WORDS = ("about us", "our story", "founded", "established")
EVENT_LIST_WORDS = (
    "event in", "events in", "upcoming event", "upcoming events", "all event", "all events",
    "browse event", "browse events",
)
TICKET_WORDS = ("buy ticket", "buy tickets", "book ticket", "book tickets", "register", "rsvp")
VENUE_WORDS = ("venue", "location", "door open", "doors open", "start time")
ACT_WORDS = ("lineup", "performer", "artist", "speaker")
APPLY_WORDS = ("apply now", "submit application", "apply for this")
APPLY_JOB_WORDS = ("apply now", "submit application", "apply for this job")
PAY_WORDS = ("salary", "compensation", "remuneration")
DUTY_WORDS = ("qualification", "qualifications", "responsibilities", "requirements")
DEADLINE_WORDS = ("deadline", "closing date", "application deadline")
JOB_VOCAB_WORDS = (
    "salary", "compensation", "qualification", "qualifications", "responsibilities",
    "requirements",
)
REPLY_WORDS = ("reply", "replies", "post reply", "original post")
CTA_FLAGS = (
    ("get started",), ("sign up",), ("try free", "try for free"),
    ("start trial", "start your trial", "start free trial", "start your free trial"),
    ("book a demo",), ("request a demo",),
    ("download app", "download now", "download the app", "download the now"),
    ("learn more",), ("watch video",), ("explore now",),
)
LEGAL_FLAGS = (
    ("privacy policy",), ("terms of service",), ("terms and conditions",), ("legal",),
    ("cookie policy",), ("disclaimer",), ("trademark",), ("compliance",),
)
INFO_FLAGS = (
    ("about us",), ("contact us",), ("get in touch",), ("help",), ("support",), ("team",),
    ("press",), ("career", "careers"),
)
RULE_INFO_FLAGS = (("about us",), ("contact us",), ("get in touch",), ("team",), ("press",))
FAQ_FLAGS = (
    ("faq",), ("frequently asked questions",), ("how can i",), ("where can i",), ("what is",),
)
MARKETING_FLAGS = (
    ("pricing",), ("plan", "plans"), ("enterprise",), ("solution", "solutions"), ("platform",),
    ("for team", "for teams", "for business", "for companies", "for organization",
     "for organizations"),
    ("free trial",), ("no credit card",),
)
PRICING_WORDS = ("pricing", "plan", "plans", "per month", "per year", "billed annually")
TESTIMONIAL_WORDS = (
    "testimonial", "review", "trusted by", "customer", "customers", "client", "case study",
)
MISSION_WORDS = (
    "our mission", "our vision", "our team", "about us", "contact us", "privacy policy",
    "terms of service", "cookie policy", "frequently asked", "get in touch",
)
BROWSE_WORDS = (
    "discover", "browse", "explore", "categories", "all show", "all shows", "all event",
    "all events", "all album", "all albums", "all artist", "all artists", "all collection",
    "all collections", "all exhibition", "all exhibitions", "all publication",
    "all publications",
)
PUBLICATION_WORDS = (
    "publication", "publications", "proceeding", "proceedings", "paper", "papers", "report",
    "reports", "preprint", "preprints", "manuscript", "manuscripts", "abstract", "abstracts",
    "bibliography", "references",
)
JOB_FILTER_WORDS = ("filter by", "sort by", "job type", "experience level")
JOB_NEWS_WORDS = (
    "new job", "new jobs", "latest job", "latest jobs", "featured job", "featured jobs",
)
FOOTER_FLAGS = (
    ("about us",), ("contact",), ("privacy",), ("terms",), ("help",), ("support",),
    ("career", "careers"),
)
RULE_BUY_WORDS = (
    "add to cart", "buy now", "add to bag", "add to basket", "purchase now", "order now",
    "buy it now", "shop now",
)
RULE_SPEC_WORDS = (
    "specification", "specifications", "spec", "specs", "display", "processor", "battery", "ram",
    "storage", "resolution", "camera", "weight", "dimension", "dimensions", "material",
    "ingredient", "ingredients", "warranty", "model number",
)
RULE_API_WORDS = (
    "function", "method", "parameter", "api", "endpoint", "return", "exception", "class", "module",
)

# Every list of whole-word phrases above; a page's words are matched against all of them in one go.
WORD_LISTS = (
    BUY_WORDS, CART_WORDS, AUTHOR_WORDS, RATING_WORDS, SHARE_WORDS, COMMENT_WORDS, RELATED_WORDS,
    CONTACT_WORDS, STORY_WORDS, EVENT_LIST_WORDS, TICKET_WORDS, VENUE_WORDS, ACT_WORDS,
    APPLY_WORDS, APPLY_JOB_WORDS, PAY_WORDS, DUTY_WORDS, DEADLINE_WORDS, JOB_VOCAB_WORDS,
    REPLY_WORDS, *CTA_FLAGS, *LEGAL_FLAGS, *INFO_FLAGS, *RULE_INFO_FLAGS, *FAQ_FLAGS,
    *MARKETING_FLAGS, PRICING_WORDS, TESTIMONIAL_WORDS, MISSION_WORDS, BROWSE_WORDS,
    PUBLICATION_WORDS, JOB_FILTER_WORDS, JOB_NEWS_WORDS, *FOOTER_FLAGS, RULE_BUY_WORDS,
    RULE_SPEC_WORDS, RULE_API_WORDS, ("filter", "refine", "sort by"),
)

# ---- patterns over the folded text --------------------------------------------------------
PAGING_PATTERN = (
    r"page\s*\d|next\s*page|previous\s*page|load\s*more|show\s*more|view\s*all|see\s*all|\bpage\b"
)
PAGE_OF_PATTERN = r"\d\s*of\s*\d"
RESULT_COUNT_PATTERN = (
    r"\b\d[\d,]*\s*(results?|listings?|items?|products?|jobs?|properties|found|matches)\b"
)
PRICE_PATTERN = (
    r"(?:[$€£¥₹]|usd|eur|gbp)\s*[\d,]+\.?\d*|[\d,]+\.?\d*\s*[$€£¥₹]"
)
PLAIN_PRICE_PATTERN = r"[$€£¥₹]\s*[\d,]|[\d,]\s*[$€£¥₹]"
PUBLISH_DATE_PATTERN = (
    r"\b(published|posted|updated|last\s+modified|date)\b.*"
    r"(\d{1,2}[/-]\d{1,2}[/-]\d{2}|\w \d{1,2},? \d{4})"
)
PUBLISH_YEAR_PATTERN = r"\b(published|posted|updated)\b.*\d{4}"
SCORE_PATTERN = r"\b\d+(\.\d+)?\s*(out of|/)\s*\d+\b"
DURATION_PATTERN = r"\b(duration|runtime)\s*[:\-]\s*\d"
ENGAGEMENT_PATTERN = (
    r"\b\d[\d,.]*k?\s*(views?|likes?|dislikes?|subscribers?|followers?|watches?)\b"
)
# Parts of words without which the patterns above and below match nothing; tested before them.
CURRENCY_SIGNS = ("$", "€", "£", "¥", "₹")
CURRENCY_CODES = ("usd", "eur", "gbp")
RESULT_COUNT_STEMS = ("result", "listing", "item", "product", "job", "properties", "found", "matches")
RULE_RESULT_STEMS = ("result", "listing", "matches", "found")
SPEC_STEMS = (
    "spec", "feature", "dimension", "weight", "material", "compatibility", "requirement", "ingredient",
)
ENGAGEMENT_STEMS = ("view", "like", "subscriber", "follower", "watch")
JOB_COUNT_STEMS = ("job", "position", "opening", "role", "vacancies")
NUMBER_PATTERN = r"^\$?[\d,]+\.?\d*$"
FIND_EVENTS_PATTERN = r"\b(explore|find|discover)\b.*\bevents?\b"
COUNT_EVENTS_PATTERN = r"\b\d+\s+events?\b"
MEMBER_PATTERN = r"\b(joined|member\s+since|posts?[:\s]\d+)\b"
EST_PATTERN = r"\best\.\b"
BYLINE_PATTERN = r"\b(by\s+[A-Z][a-z]+|author[:\s]|written\s+by)\b"  # case matters: original text
YEAR_PATTERN = r"\b(19|20)\d{2}\b"
WORK_MODE_PATTERN = r"\b(full[- ]time|part[- ]time|remote|hybrid|on[- ]site)\b"
JOB_COUNT_PATTERN = r"\b\d[\d,]*\s*(jobs?|positions?|openings?|roles?|vacancies)\b"
ACADEMIC_HOST = r"\.(edu|ac\.uk|gov|org)$"

# ---- rule patterns ------------------------------------------------------------------------
ERROR_PATTERNS = (
    r"\b404\b.*\bnot found\b",
    r"\bpage not found\b",
    r"\b404 error\b",
    r"\bnot found\b.*\b404\b",
    r"\bthis page (doesn'?t|does not) exist\b",
    r"\bpage (has been )?removed\b",
    r"\bno longer available\b",
    r"\bfile not found\b",
    r"\b500\b.*\binternal server error\b",
    r"\bservice unavailable\b",
    r"\baccess denied\b",
    r"\bforbidden\b",
    r"\b403\b.*\bforbidden\b",
    r"\bcaptcha\b",
    r"\bjust a moment\b",
    r"\bchecking your browser\b",
    r"\bddos.guard\b",
    r"\bcf-browser-verification\b",
    r"\bare you a robot\b",
    r"\bverify you are human\b",
)
# each of the patterns above asks for one of these
ERROR_PARTS = (
    "404", "found", "exist", "removed", "available", "internal server error", "denied", "forbidden", "captcha",
    "just a moment", "checking your browser", "ddos", "cf-browser-verification", "are you a robot", "verify you are human",
)
BLOCK_PHRASES = (
    "cf-browser-verification", "challenge-form", "cf_clearance", "ray id", "just a moment",
    "ddos-guard", "please verify you are a human", "access denied", "403 forbidden", "captcha",
    "enable javascript", "checking your browser", "security check", "bot detection",
    "are you a robot",
)
# those of the phrases above that sites put into ids, classes, names and form actions
CHALLENGE_MARKS = ("cf-browser-verification", "challenge-form", "cf_clearance", "ddos-guard")
RULE_PAGING_PATTERN = r"\b(next\s*page|previous\s*page|load\s*more|showing\s+\d)"
RULE_RESULT_PATTERN = (
    r"\b(\d[\d,]*)\s*(results?|listings?|items?\s+found|products?\s+found|jobs?\s+found|matches|"
    r"properties?\s+found)\b"
)
RULE_PRICE_PATTERN = (
    r"(?:[$€£¥₹]|usd|eur|gbp)\s*[\d,]|[\d,]\s*[$€£¥₹]|\bprice[:\s]"
)
RULE_RATING_PATTERN = (
    r"\b(\d+(\.\d+)?)\s*(out\s+of|/)\s*5\b|\b\d+\s*(reviews?|ratings?|stars?)\b|"
    r"\bcustomer\s+(reviews?|ratings?)\b"
)
RULE_BYLINE_PATTERN = r"\b(by\s+\w+|author[:\s]|written\s+by|published)\b"
JOB_BOARDS = (
    "lever.co", "greenhouse.io", "workable.com", "smartrecruiters.com", "applytojob.com",
    "jobs.lever.co", "boards.greenhouse.io", "jobs.greenhouse.io", "monster.com", "indeed.com",
    "glassdoor.com", "linkedin.com/jobs", "ziprecruiter.com", "bamboohr.com",
)
JOB_PATHS = ("/jobs", "/search", "/careers")
JOB_HOSTS = ("boards.greenhouse.io", "jobs.lever.co")
API_DOCS = (
    ("docs.python.org", "Python docs", "/library/"),
    ("developer.mozilla.org", "MDN Docs", "/en-US/docs/"),
    ("docs.aws.amazon.com", "AWS Docs", "/docs/"),
    ("github.com/docs", "GitHub Docs", "/docs/"),
    ("api.github.com", "GitHub API", ""),
)
SOCIAL_BROWSE = (
    ("vimeo.com/categories", "video_categories"),
    ("vimeo.com/category", "video_category"),
    ("music.apple.com/browse", "music_browse"),
    ("soundcloud.com/discover", "music_discover"),
    ("soundcloud.com/stream", "music_stream"),
    ("dribbble.com/tags", "design_tags"),
    ("behance.net", "portfolio_listing"),
    ("spotify.com/genre", "music_genre"),
    ("bandcamp.com/tags", "music_tags"),
)
RULE_CONFIDENCE = {
    "error_page": 0.97, "schema_org": 0.96, "rss_feed": 0.93, "open_graph": 0.93,
    "twitter_card": 0.93, "strong_listing": 0.90, "job_board": 0.90, "api_docs": 0.92,
    "arxiv": 0.88, "wikipedia": 0.85, "social": 0.88, "browse": 0.86, "others_signals": 0.90,
}
