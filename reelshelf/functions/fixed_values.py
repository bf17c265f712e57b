"""Labels, limits and formats that results must agree on."""

# --- Fixed values: content types -------------------------------------------
SCOPES = {
    "ANIME": ("ANIME",),
    "MANGA": ("MANGA",),
    "MANHWA": ("MANHWA",),
    "ALL": ("ANIME", "MANGA", "MANHWA"),
}
PRINT_TYPES = {"manga": "MANGA", "manhwa": "MANHWA"}

# --- Fixed values: anime labels --------------------------------------------
SEASONS = ("winter", "spring", "summer", "fall")
ANIME_TYPE_ALIASES = {"TV SPECIAL": "SPECIAL"}
ANIME_STATUS_ALIASES = {
    "AIRING": "CURRENTLY_AIRING",
    "CURRENTLY_AIRING": "CURRENTLY_AIRING",
    "FINISHED": "FINISHED_AIRING",
    "FINISHED_AIRING": "FINISHED_AIRING",
    "NOT_YET_AIRED": "NOT_YET_AIRED",
    "NOT_YET_AIRING": "NOT_YET_AIRED",
}
ADULT_NAMES = ("hentai", "erotica")
ADULT_RATING = "hentai"
TAG_FIELDS = ("genres", "explicit_genres", "themes", "demographics")

# --- Fixed values: sorts ----------------------------------------------------
COMMON_SORTS = ("top_rated", "newest", "oldest", "title", "most_popular", "most_members")
ANIME_SORTS = (*COMMON_SORTS, "most_episodes")
PRINT_SORTS = (*COMMON_SORTS, "most_chapters")
SEASONAL_SORTS = ("top_rated", "most_popular", "most_members")

# --- Fixed values: parameter bounds ----------------------------------------
SCORE_BOUNDS = (0, 10)
YEAR_BOUNDS = (1, 3000)
EPISODE_BOUNDS = (1, 10_000)
CHAPTER_BOUNDS = (1, 1_000_000)
VOLUME_BOUNDS = (1, 100_000)
PER_PAGE_DEFAULT, PER_PAGE_MAX = 24, 100
FACET_PAGE_MAX = 100
RANDOM_DEFAULT, RANDOM_MAX = 6, 12
RANDOM_SAMPLE_FRACTION = 0.02
FACET_VALUE_LENGTH = 255
ENTITY_NAME_LENGTH = 150
AUTHOR_NAME_LENGTH = 200
AUTHOR_ROLE_LENGTH = 100
STATE_ERROR_LENGTH = 500
DEGRADED_MIN_SELECTED, DEGRADED_RATE = 100, 0.25

# --- Fixed values: provider protocol ---------------------------------------
TEMPORARY_STATUS_CODES = (429, 500, 502, 503, 504)
PROVIDER_LAST_PAGE = 1000
ANIME_TITLE_FALLBACK = "MAL anime "
ANIME_URL_FALLBACK = "https://myanimelist.net/anime/"
MANGA_TITLE_FALLBACK = "MAL manga "
MANGA_URL_FALLBACK = "https://myanimelist.net/manga/"
PERSON_TYPES = ("people", "person")
SUPPLEMENTAL_TYPES = ("movie", "ova", "ona", "special", "tv_special")

# --- Fixed values: scheduled limits ----------------------------------------
REFRESH_LIMIT = 1000
STREAMING_LIMIT = 2000

# --- Fixed values: visit tracking ------------------------------------------
VISIT_ROUTE = "frontend"
HEALTH_PATHS = ("/health", "/healthz", "/ready", "/readyz")
EXCLUDED_PREFIXES = ("/api/v1", "/assets/", "/static/")
BROWSER_PREFIX = "mozilla/"
BOT_MARKERS = (
    "bot",
    "crawler",
    "spider",
    "slurp",
    "facebookexternalhit",
    "uptimerobot",
    "kube-probe",
    "elb-healthchecker",
    "github-actions",
    "go-http-client",
    "headlesschrome",
    "insomnia",
    "okhttp",
    "postmanruntime",
    "python-requests",
    "curl/",
    "wget/",
)

# --- Fixed values: streaming brands, first match wins ----------------------
SERVICE_BRANDS = (
    ("myanimelist", ("myanimelist", "my anime list")),
    ("crunchyroll", ("crunchyroll",)),
    ("netflix", ("netflix",)),
    ("hulu", ("hulu",)),
    ("prime-video", ("prime video", "primevideo", "amazon.com/gp/video")),
    ("hotstar", ("hotstar",)),
    ("disney-plus", ("disney+", "disney plus", "disneyplus")),
    ("hidive", ("hidive",)),
    ("funimation", ("funimation",)),
    ("youtube", ("youtube", "youtu.be")),
    ("tubi", ("tubi",)),
    ("peacock", ("peacocktv", "peacock tv")),
    ("retrocrush", ("retrocrush",)),
    ("max", ("hbo max", "hbomax", "max.com")),
    ("apple-tv", ("apple tv", "tv.apple.com")),
)
BRAND_FALLBACK = "external"
