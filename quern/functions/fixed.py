"""Names, patterns and word lists whose content decides results.

They are stated as they are; none is computed.
"""

# Order of page types on a wall, in a store profile, and of a flow.
WALL_PAGES = ("home", "collection", "product")
PROFILE_PAGES = ("home", "collection", "product", "cart", "checkout", "page", "blog", "article", "other")
FLOW_STEPS = ("home", "collection", "product", "cart")
FLOW_REQUIRED = ("home", "collection", "product")

# Facet keys.
FILTER_KEYS = ("page", "block", "vp", "platform", "theme", "app", "industry", "country", "host", "video", "color")
FREE_FILTER_KEYS = ("host", "block", "vp")

# Platforms that sell.
STORE_PLATFORMS = ("shopify", "woocommerce", "bigcommerce", "magento", "salesforce", "prestashop", "shopware", "squarespace-commerce", "wix-stores")
STORE_SOURCES = ("ecomm", "gallery", "catalog")

# Page builders by the mark they leave in a hosted store's page, first match wins.
BUILDER_MARKS = (("gempages", "gempages"), ("pagefly", "pagefly"), ("getshogun", "shogun"), ("replo", "replo"), ("hydrogen", "hydrogen"))

# Third-party apps and the pattern that gives them away.
APP_PATTERNS = (
    ("Klaviyo", "klaviyo|_learnq"),
    ("Recharge", "rechargepayments|rechargeapps"),
    ("Skio", r"skio\.com|skio-subscriptions|getskio"),
    ("Loop Subscriptions", r"loopwork\.co|loopsubscriptions"),
    ("Rebuy", "rebuyengine"),
    ("Gorgias", "gorgias"),
    ("Judge.me", r"judge\.me|judgeme"),
    ("Loox", r"loox\.io"),
    ("Okendo", "okendo"),
    ("Yotpo", "yotpo"),
    ("Stamped", r"stamped\.io"),
    ("Junip", r"junip\.co"),
    ("Hotjar", "hotjar"),
    ("Microsoft Clarity", r"clarity\.ms"),
    ("Google Tag Manager", r"googletagmanager\.com/gtm\.js"),
    ("Google Analytics", r"gtag/js|google-analytics\.com|googletagmanager\.com/gtag"),
    ("Meta Pixel", r"connect\.facebook\.net|fbq\("),
    ("TikTok Pixel", r"analytics\.tiktok\.com|ttq\."),
    ("Pinterest Tag", r"pintrk|ct\.pinterest\.com"),
    ("Snap Pixel", r"sc-static\.net|snaptr\("),
    ("Attentive", r"attn\.tv|attentivemobile"),
    ("Postscript", r"postscript\.io"),
    ("Privy", r"privy\.com|privymktg"),
    ("Justuno", "justuno"),
    ("Shopify Inbox", r"shopify-chat|inbox\.shopify"),
    ("Intelligems", "intelligems"),
    ("Triple Whale", "triplewhale"),
    ("Northbeam", "northbeam"),
    ("Elevar", "elevar"),
    ("Wishlist Plus", "swymrelay|swym"),
    ("Klarna", "klarna"),
    ("Afterpay", "afterpay"),
    ("Sezzle", "sezzle"),
    ("Shop Pay", r"shop\.app|shopifypay|shop-pay"),
    ("PayPal", r"paypal\.com"),
    ("Tolstoy", "gotolstoy"),
    ("Vimeo", r"player\.vimeo\.com"),
    ("YouTube", r"youtube\.com/embed|youtube-nocookie"),
    ("Typeform", "typeform"),
    ("HubSpot", r"hs-scripts\.com|hsforms|hubspot"),
    ("Mailchimp", "chimpstatic|mailchimp|list-manage"),
    ("ActiveCampaign", "activehosted|activecampaign"),
    ("Zendesk", "zendesk|zdassets"),
    ("Intercom", "intercom"),
    ("Tidio", "tidio"),
    ("Crisp", r"crisp\.chat"),
    ("Cookie consent (OneTrust)", r"onetrust|cookielaw\.org"),
    ("Cookie consent (Cookiebot)", "cookiebot"),
    ("Cookie consent (Pandectes)", "pandectes"),
    ("Weglot", "weglot"),
    ("Smile.io", r"smile\.io"),
    ("LoyaltyLion", "loyaltylion"),
    ("Bold", "boldapps|boldcommerce"),
    ("Globo", "globosoftware"),
    ("Fera", r"fera\.ai"),
    ("Searchanise", "searchanise"),
    ("Boost Commerce", "boostcommerce|boost-pfs"),
    ("Algolia", "algolia"),
    ("Nosto", r"nosto\.com"),
    ("Dynamic Yield", "dynamicyield"),
    ("Optimizely", "optimizely"),
    ("VWO", "visualwebsiteoptimizer"),
    ("Segment", r"cdn\.segment\.com"),
    ("Sentry", r"sentry\.io|sentry-cdn"),
    ("Cloudflare", "cloudflareinsights|cdn-cgi"),
)

# Signs of a shop in a page.
STRONG_SIGNALS = (
    "add to cart", "add-to-cart", "addtocart", "add to bag", "product-form", '"@type":"product"', '"@type": "product"', "data-product",
    "/products/", "/collections/", "shopping cart", "your cart", "sold out", "pricecurrency", 'href="/cart',
)
WEAK_SIGNALS = ("checkout", "/product/", "buy now", "shop now", "shopping bag", "basket", "free shipping", "itemlistelement", "shop all")
STORE_TITLE = r"\b(online (shop|store|shopping|boutique)|online [a-z]+ store|official (online )?(shop|store|website & store|site & store)|shop online|buy online|e-?shop|webshop|web store)\b|^shop\b"
SPAM_TITLE = r"\b(slot ?gacor|slot online|slot777|togel|judi|sbobet|casino|poker online|deposit otomatis|situs slot|link alternatif|bet365|1xbet)\b|app store$|apps\.apple\.com"
PARKED_MARKS = (
    "this domain is for sale", "domain for sale", "buy this domain", "sedoparking", "hugedomains", "afternic", "dan.com", "parked free", "domain is parked",
    "godaddy.com/domainsearch", "namecheap.com/domains", "coming soon", "under construction", "website is temporarily unavailable", "account suspended",
)
SMALL_PAGE_MARKS = ("coming soon", "under construction")
ADULT_MARKS = ("sex toy", "sex toys", "adult toy", "adult toys", "porn", "xxx", "dildo", "vibrator", "escort", "casino", "sportsbook", "betting")

# Pages that stand in for the page asked for, first match wins.
WALL_PATTERNS = (
    ("human-check", "verify (that )?you('| a)?re (a |not a )?(human|robot)|press (&|and) hold|are you a robot|complete the security check|checking (if the site connection is secure|your browser)|just a moment|needs to review the security of your connection"),
    ("access-denied", "access (to this page has been |is )?denied|you don.?t have permission to access|request unsuccessful|pardon our interruption|unusual traffic|has been blocked|sorry, you have been blocked"),
    ("geo-block", "restricted access|(not available|unavailable|cannot visit|can.?t visit|not accessible|do not ship|don.?t ship).{0,60}(your (current )?(location|country|region))"),
    ("error-page", "something went wrong|an (unexpected )?error (has )?occurred|internal server error|service (is )?(temporarily )?unavailable|we.?re sorry, (something|an error|this page)"),
    ("location-gate", "(choose|select|pick) your (location|country|region|shipping destination|delivery country)|where (do you want|would you like) (us )?to (ship|deliver)"),
)
ELSEWHERE_HOSTS = r"(^|\.)(amazon\.[a-z.]{2,6}|etsy\.com|ebay\.[a-z.]{2,6}|walmart\.com|aliexpress\.com|linktr\.ee|facebook\.com|instagram\.com|tiktok\.com|hugedomains\.com|dan\.com|sedo\.com|afternic\.com|godaddy\.com)$"
BROWSER_GONE = r"browser:|has been closed|Target closed|Browser closed|disconnected|crashed"
TRANSIENT = r"^dead$|robots-unreachable|page-timeout|ERR_TIMED_OUT|ERR_NETWORK|ERR_CONNECTION_RESET|ERR_CONNECTION_TIMED_OUT|ERR_NAME_NOT_RESOLVED|ERR_HTTP2_PROTOCOL_ERROR|ERR_ABORTED|ERR_INTERNET_DISCONNECTED|http-429|http-5\d\d|Timeout \d+ms exceeded|browser:|has been closed|crashed"

# Page types by path, first match wins.
PAGE_TYPE_PATTERNS = (
    (r"^/$", "home"),
    (r"^/collections/[^/]+/products/[^/]+", "product"),
    (r"^/products?/[^/]+", "product"),
    (r"^/(p|item|shop/p|dp)/[^/]+", "product"),
    (r"^/collections/[^/]+|^/(product-category|category|categories|shop|collection|c)(/[^/]+)+$", "collection"),
    (r"^/(collections|shop|store)$", "collection-list"),
    (r"^/cart|^/(basket|bag)(/|$)|(^|/)checkout/cart(/|$)", "cart"),
    (r"checkout", "checkout"),
    (r"^/search", "search"),
    (r"^/(account|login|signin|register)", "account"),
    (r"^/blogs/[^/]+/[^/]+|^/blog/[^/]+", "article"),
    (r"^/blogs?(/|$)|^/news(/|$)", "blog"),
    (r"^/pages/", "page"),
)
LOCALE_PREFIX = r"(?i)^/(?:[a-z]{2}(?:[-_][a-z]{2})?)(?:/(?:[a-z]{2}(?:[-_][a-z]{2})?))?(?=/|$)"
SECTION_WORDS = (
    "announcement", "hero", "banner", "slideshow", "testimonial", "review", "faq", "newsletter", "pricing", "feature", "logo", "video",
    "collection", "product", "gallery", "cta", "contact", "team", "blog", "footer", "header",
)

# Countries by domain ending and by currency.
ENDING_COUNTRY = {
    "co.uk": "GB", "uk": "GB", "ie": "IE", "de": "DE", "fr": "FR", "nl": "NL", "be": "BE", "es": "ES", "it": "IT", "pt": "PT", "se": "SE", "no": "NO", "dk": "DK", "fi": "FI",
    "ch": "CH", "at": "AT", "pl": "PL", "cz": "CZ", "ca": "CA", "com.au": "AU", "au": "AU", "co.nz": "NZ", "nz": "NZ", "jp": "JP", "co.jp": "JP", "kr": "KR", "sg": "SG",
    "hk": "HK", "in": "IN", "co.in": "IN", "com.br": "BR", "br": "BR", "mx": "MX", "com.mx": "MX", "ar": "AR", "za": "ZA", "co.za": "ZA", "ae": "AE", "il": "IL",
    "co.il": "IL", "tr": "TR", "com.tr": "TR", "gr": "GR", "ro": "RO", "hu": "HU", "ua": "UA", "ru": "RU", "cn": "CN", "tw": "TW", "th": "TH", "vn": "VN", "ph": "PH",
    "id": "ID", "my": "MY", "xk": "XK", "al": "AL",
}
CURRENCY_COUNTRY = {
    "USD": "US", "GBP": "GB", "EUR": "EU", "CAD": "CA", "AUD": "AU", "NZD": "NZ", "JPY": "JP", "SEK": "SE", "NOK": "NO", "DKK": "DK", "CHF": "CH", "PLN": "PL", "INR": "IN",
    "BRL": "BR", "MXN": "MX", "SGD": "SG", "HKD": "HK", "KRW": "KR", "ZAR": "ZA", "AED": "AE", "ILS": "IL", "TRY": "TR", "CZK": "CZ", "HUF": "HU",
}

# Phrases that mark each kind of block, and other names for the kinds.
KIND_PHRASES = {
    "announcement-bar": ("announcement", "free shipping", "limited time"),
    "header-navigation": ("menu", "navigation", "shop all"),
    "hero": ("hero", "shop now", "discover"),
    "usp-bar": ("free shipping", "free returns", "guarantee"),
    "logo-press-bar": ("as seen in", "featured in", "press"),
    "image-with-text": ("story", "learn more"),
    "video": ("video", "watch", "play"),
    "features-grid": ("features", "benefits", "ingredients"),
    "testimonials": ("testimonials", "what our customers say", "loved"),
    "ugc-gallery": ("instagram", "tiktok", "tag us"),
    "faq": ("faq", "faqs", "frequently asked", "questions"),
    "newsletter": ("newsletter", "sign up", "subscribe", "email", "inbox"),
    "cta-band": ("get started", "shop now", "join now"),
    "footer": ("footer", "privacy policy", "terms of service", "copyright"),
    "comparison-table": ("vs", "versus", "compare", "us vs them", "others"),
    "pricing": ("pricing", "plans", "per month", "per year", "tier"),
    "team": ("team", "founders", "meet the"),
    "blog-teasers": ("blog", "journal", "articles", "read more"),
    "contact": ("contact", "get in touch", "phone"),
    "stats": ("customers", "5-star", "million"),
    "how-it-works": ("how it works", "step", "steps"),
    "app-download": ("app store", "google play", "download the app"),
    "trust-badges": ("secure checkout", "certified", "guarantee", "badges"),
    "featured-collection": ("best sellers", "bestsellers", "featured", "shop all"),
    "collection-grid": ("collection", "products", "sort by", "filter"),
    "product-card": ("add to cart", "quick add", "quick view"),
    "filter-sort-bar": ("filter", "sort by", "price range"),
    "product-gallery": ("gallery", "zoom", "thumbnails"),
    "buy-box": ("add to cart", "quantity", "buy now", "size", "variant"),
    "subscription-picker": ("subscribe and save", "subscribe & save", "subscribe", "subscription", "autoship", "auto-ship", "one-time purchase", "deliver every", "delivered every", "ships every", "delivery frequency", "recurring"),
    "bundle-builder": ("bundle", "build your", "kit", "mix and match"),
    "size-guide": ("size guide", "size chart", "measurements"),
    "shipping-returns": ("shipping", "returns", "delivery", "refund"),
    "product-tabs": ("description", "ingredients", "how to use", "details"),
    "product-reviews": ("reviews", "review", "rating", "ratings", "rated", "stars", "verified buyer", "verified reviewer"),
    "cross-sell-upsell": ("you may also like", "frequently bought together", "complete the look", "pairs well"),
    "recently-viewed": ("recently viewed",),
    "sticky-add-to-cart": ("add to cart",),
    "cart-drawer": ("cart", "subtotal", "checkout"),
    "cart-page": ("cart", "subtotal", "checkout", "order summary"),
    "checkout-step": ("checkout", "shipping", "payment"),
    "order-confirmation": ("thank you", "order confirmed", "order number"),
    "account": ("login", "sign in", "account", "register"),
    "search-results": ("search results", "results"),
    "quiz-finder": ("quiz", "find your", "take the quiz"),
    "store-locator": ("store locator", "find a store", "stockists"),
    "gift-card": ("gift card", "e-gift"),
}
KIND_ALIASES = {
    "header-navigation": (("header",), ("navigation",), ("nav",), ("menu",)),
    "announcement-bar": (("announcement",),),
    "usp-bar": (("usp",),),
    "logo-press-bar": (("press",), ("logo", "bar"), ("logos",)),
    "features-grid": (("features",), ("benefits",)),
    "testimonials": (("testimonial",),),
    "ugc-gallery": (("ugc",), ("instagram",)),
    "faq": (("faqs",), ("questions",)),
    "newsletter": (("signup",), ("sign", "up"), ("email", "capture")),
    "comparison-table": (("comparison",), ("compare",)),
    "blog-teasers": (("blog",), ("articles",)),
    "how-it-works": (("steps",), ("timeline",)),
    "trust-badges": (("trust",),),
    "collection-grid": (("product", "grid"),),
    "subscription-picker": (("subscribe", "save"), ("autoship",), ("subscription", "selector"), ("subscription", "toggle"), ("subscription", "options")),
    "bundle-builder": (("bundle",), ("build", "box")),
    "size-guide": (("size", "chart"), ("fit", "guide")),
    "shipping-returns": (("shipping",), ("returns",)),
    "product-reviews": (("reviews",), ("ratings",), ("review",)),
    "cross-sell-upsell": (("upsell",), ("cross", "sell"), ("recommendations",)),
    "quiz-finder": (("quiz",), ("finder",)),
    "store-locator": (("stockists",),),
}

# What a page's platform shows by, first one wins. An entry holds if all marks of one of its
# groups show; where one of the marks at its end shows as well, the platform has the second name.
PLATFORM_MARKS = (
    ((("cdn.shopify.com",), ("shopify.theme",), ("myshopify.com",)), "shopify", ()),
    ((("woocommerce",),), "woocommerce", ()),
    ((("bigcommerce",),), "bigcommerce", ()),
    ((("demandware",), ("salesforce-commerce",)), "salesforce", ()),
    ((("/static/version", "mage/"), ("magento",)), "magento", ()),
    ((("prestashop",),), "prestashop", ()),
    ((("shopware",),), "shopware", ()),
    ((("squarespace",),), "squarespace", ("squarespace-commerce", "sqs-cart", "products/")),
    ((("wixstatic.com",), ("parastorage.com",)), "wix", ("wix-stores", "wixstores", "wix-stores")),
    ((("data-wf-site",), ("webflow",)), "webflow", ()),
    ((("framerusercontent.com",),), "framer", ()),
    ((("/_next/",),), "nextjs", ()),
    ((("__nuxt",),), "nuxt", ()),
    ((("/wp-content/",),), "wordpress", ()),
)
# Patterns of a page's theme, currency, country and locale.
THEME_OBJECT = r"Shopify\.theme\s*=\s*(\{[^;]*\})\s*;"
THEME_NAMES = (r'"schema_name"\s*:\s*"([^"]+)"', r'"name"\s*:\s*"([^"]+)"')
THEME_VERSION = r'"schema_version"\s*:\s*"([^"]+)"'
THEME_FOLDER = r"/wp-content/themes/([a-z0-9_-]+)/"
CURRENCIES = (r'Shopify\.currency\s*=\s*\{"active":"([A-Z]{3})"', r'"priceCurrency"\s*:\s*"([A-Z]{3})"')
COUNTRY = r'Shopify\.country\s*=\s*"([A-Z]{2})"'
LOCALES = (r'Shopify\.locale\s*=\s*"([a-z]{2}(?:-[A-Za-z]{2})?)"', r'<html[^>]*\slang="([a-zA-Z]{2}(?:-[a-zA-Z]{2})?)"')

# What a quick look at a page goes by, first platform wins; all marks of one entry must show.
PROBE_PLATFORMS = (
    (("cdn.shopify.com",), "shopify"), (("shopify.theme",), "shopify"), (("woocommerce",), "woocommerce"), (("/wp-content/",), "wordpress"), (("bigcommerce.com",), "bigcommerce"), (("data-wf-site",), "webflow"),
    (("squarespace",), "squarespace"), (("wixstatic.com",), "wix"), (("demandware",), "salesforce"), (("/static/version", "mage/"), "magento"), (("/_next/",), "nextjs"),
)
PROBE_STORES = ("shopify", "woocommerce", "bigcommerce", "magento", "salesforce")
PROBE_SIGNALS = (
    "add to cart", "add-to-cart", "addtocart", 'href="/cart', "checkout", '"@type":"product"', '"@type": "product"', "data-product", "product-form", "/products/", "/collections/", "/product/",
    "buy now", "shop now", "shopping bag", "shopping cart", "your cart", "basket", "free shipping", "sold out", "add to bag",
)
