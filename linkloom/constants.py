"""Lists, patterns and limits that results depend on. Each use has its own list, even where lists look alike."""

# Hosts and paths of the archive origin.
ARCHIVE_HOST = "static.tp-link.com"
SISTER_HOST = "static.mercusys.com"
ORIGIN = r"^https://s3\.amazonaws\.com/"
DATE_ROOT = "/upload/gpl-code/"
FLAT_ROOT = "/resources/gpl/"
PICKER_URL = "https://www.tp-link.com/en/choose-your-location/"
REGION_PAGE = "https://www.tp-link.com/{region}/support/gpl-code/"
MODEL_PAGE = "https://www.tp-link.com/phppage/gpl-res-list.html"

# Suffixes of archives: gate before verification, fallback on region pages, candidates.
GATE_EXTENSIONS = (".tar.gz", ".tgz", ".tar.bz2", ".tar.bz", ".tar.xz", ".tar", ".zip", ".rar", ".gz", ".bz2", ".bz", ".7z", ".xz")
FALLBACK_EXTENSIONS = (".tar.gz", ".tar.bz2", ".tar.xz", ".tar", ".zip", ".rar", ".tgz", ".gz", ".bz2", ".xz", ".7z")
CANDIDATE_EXTENSIONS = ("tar.gz", "tar.bz2", "tar", "tgz", "zip", "rar", "gz", "bz2")

# Region codes.
REGIONS = (
    "ar", "at", "au", "be", "br", "ch", "cl", "co", "cz", "de", "dk", "es", "fi", "fr", "gr", "hk", "hu", "id", "in", "it", "jp", "kr", "mx", "my",
    "nl", "no", "nz", "ph", "pl", "pt", "ro", "se", "sg", "th", "tw", "uk", "us", "vn",
)
PROBE_REGIONS = ("us", "de", "fr", "in", "br", "jp")
SISTER_REGIONS = (
    "en", "ca", "fr-ca", "mx", "ar", "br", "cl", "co", "pe", "ec", "cac", "au", "in", "my", "vn", "kz", "kr", "th", "bd", "hk", "id", "ph", "jp", "sg",
    "de", "es", "uk", "ua", "pt", "fr", "ro", "nordic", "bg", "cz", "it", "pl", "tr", "baltic", "hu", "gr", "eg", "pk", "za", "ae", "saudi", "ma",
)
SISTER_SAMPLE = ("en", "de", "jp", "br")

# Extraction patterns.
HREF = r"""href\s*=\s*["']\s*(https://static\.tp-link\.com/[^"']+)["']"""
HREF_FALLBACK = r"""href=["'](https://static\.tp-link\.com/[^"'>]+)["']"""
ARCHIVE_URL = r"""https://static\.(?:tp-link|mercusys)\.com/[^\s"'<>)]+"""
SISTER_URL = r"""https://static\.mercusys\.com/gpl/[^\s"'<>)]+"""
TRAILING = ".,;:!?'\""
PICKER_REGION = r'href="[^"]*?/([a-z]{2,3})/"'
MODEL_LINK = r"""\?model=([^"'&]+)"""
DATE_SEGMENT = r"(?:upload/gpl-code/|/)(\d{4}/\d{6}/\d{8}/)"

# Model tokens of firmware and archive names.
TOKEN_EXTENSION = r"(?i)\.(bin|zip|gz|rollback|scv|ico|exe|deb|rar|img|tar|bz2|crdownload|tgz|xz|7z)$"
TOKEN_ARCHIVE = r"(?i)\.(tar\.gz|tar\.bz2|tar\.xz|tgz|tar|zip|rar|gz|bz2|xz|7z)$"
TOKEN_MARKERS = r"(?i)[._-]*(?:gpl|code|source|src|new)[._-]*"
BRANDS = "Tapo|Archer|Deco|Vigi|Festa|Aginet|Kasa|Omada|Neffos|Mercusys"
REGION_TAGS = (
    "US", "EU", "UN", "JP", "CN", "RU", "BR", "AU", "KR", "TH", "IN", "EG", "KZ", "UK", "CA", "MX", "TR", "VN", "ID", "MY", "SG", "PH", "AE", "SA",
    "IL", "UA", "KG", "UZ", "RO", "PL", "CZ", "HU", "GR", "PT", "ES", "IT", "FR", "DE", "NL", "BE", "CH", "AT", "DK", "FI", "NO", "SE", "HK", "TW",
    "EN", "ROW", "WW", "LA",
)
_TAGS = "|".join(sorted(REGION_TAGS, key=lambda t: (-len(t), t)))
TOKEN_VERSION = rf"(?:(?<=\d)v\d|[ _-]v\d|[ _-]V\d|[ _-]\d+\.\d|[ _-]?\d{{6,}}|[ _-](?:{_TAGS})\b|\bBuild\b|[ _-]up[ _-]|[ _-]rel|[ _-]signed|\d{{4}}-\d\d-\d\d)"
TOKEN_TAIL = rf"(?i)(?: (?:{_TAGS}|v?\d+(?:\.\d+)*[a-z]?))+$"
ARCHER_SERIES = r"(?i)^(?:AX|AXE|AC|GX|BE|EX|A|C|GE)\d"
DECO_SERIES = r"(?i)^(?:X|XE|BE|PX|M|S|P)\d"
TOKEN_LENGTHS = (2, 40)

# Models of firmware keys.
FIRMWARE_REGION = r"_(?:JP|US|EU|AU|UK|KR|TW|CN|IN|SA|RU|CA|UN|BR|MX|AR|DE|FR|ES|NL|SE|PL|SG|MY|TH|PH|ID|VN|HK|NZ|NO|DK|FI|PT|BE|CH|GR|HU|RO|AT|CZ|CL|CO)(?=[-_]|$)"
FIRMWARE_VERSION = r"(?:_\d+\.\d+|-[Uu][Pp]-|-[Uu][Pp][Vv]|_\[20|-\[20|_20\d{6}|-20\d{2}-\d{2}-\d{2})"
FIRMWARE_EXTENSION = r"(?i)\.(bin|tar\.gz|zip|tar\.bz2|tar|gz|bz2|rar|rollback)$"
FIRMWARE_STAMP = r"(?i)_\d{10,13}(\.[a-z0-9]+)?$"
FIRMWARE_LEAST = 3

# Patterns of archive names.
PATTERN_EXTENSION = r"(?i)\.(bin|tar\.gz|tar\.bz2|zip|tar|gz|bz2|rar|tgz|rollback)$"
PATTERN_NOISE = r"[_-]\d{8}$|[_-][Vv]\d+$|[_-]\d+$"
PATTERN_SUFFIXES = ("_src", "_code", "_SRC", "_CODE", "_OpenSource", "_opensource")
CANONICAL_PATTERNS = ("GPL_{model}", "{model}_GPL", "{model}_gpl")
REUPLOADS = ("_2", "_3", "_v2", "V2")
FIRST_DAY, FIRST_BARE_DAY = "2021-01-01", "2018-01-01"

# What sources ask for.
CDX_PREFIXES = ("static.tp-link.com/resources/gpl/*", "static.tp-link.com/upload/gpl-code/*", "static.tp-link.com/20*", "static.mercusys.com/gpl/*")
CRAWL_PREFIXES = ("static.tp-link.com/*", "static.mercusys.com/gpl/*")
CODE_QUERIES = ("static.tp-link.com/upload/gpl-code in:file", "static.tp-link.com/resources/gpl in:file", "static.mercusys.com/gpl in:file")
CODE_ENDPOINTS = ("/search/code", "/search/issues")
CODE_HITS = 1000
CDX_ENDPOINT = "https://web.archive.org/cdx/search/cdx"
CRAWL_LISTING = "https://index.commoncrawl.org/collinfo.json"
CODE_HOST = "https://api.github.com"
ORGANISATION = "TP-LINK"
ORGANISATION_QUERY = "static.tp-link.com/upload/gpl-code user:TP-LINK in:file"
LISTING_HOST = "https://www.reddit.com"
LISTING_QUERIES = ("static.tp-link.com gpl", "static.tp-link.com")
DISCOURSE_SEARCH = "https://forum.openwrt.org/search.json"
WEB_SEARCH = "https://www.google.com/search"
SISTER_SITE = "https://www.mercusys.com"

# Names of sources, which are names of their files, and what the summary calls them.
SOURCE_LABELS = {
    "regional_crawl": "Regional crawl URLs", "wayback_cdx": "Wayback CDX URLs", "common_crawl": "Common Crawl URLs", "github_search": "GitHub search URLs",
    "tplink_github": "TP-Link GitHub URLs", "mercusys_regional": "Mercusys URLs", "reddit": "Reddit URLs", "forums": "Forum URLs", "google": "Google URLs", "model_sweep": "Model-sweep URLs",
}
HIT_FILES = {"dates": "bruteforce_dates.txt", "models": "bruteforce_models.txt"}
#: Inputs that are sought in the data folders where none are given.
LISTING_FILE, CORPUS_FILE = "firmware_s3_listing.json", "scrapes/seed/gpl_urls_master.txt"
SUBREDDITS = ("openwrt", "tplink", "homelab", "netsec")
DORK_DOMAINS = ("forum.dd-wrt.com", "snbforums.com", "linksysinfo.org")
BLOCKED = (401, 403, 429, 451)
