"""Demographics, tiers, thresholds, label synonyms, reject folders."""

DEMOGRAPHICS = ["Men_Under_35", "Men_35_to_50", "Men_Over_50",
                "Women_Under_35", "Women_35_to_50", "Women_Over_50"]
AESTHETIC_TIERS = ["1_Needs_Improvement", "2_Average", "3_Polished"]
STREAMS = ["Outfit", "Face_Grooming"]

MIN_EDGE_PX = 480
MAX_ASPECT = 2.5
MIN_LAPLACIAN = 60.0
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp", ".gif"]

FEMALE_WORDS = ["female", "woman", "women"]
YOUNG_WORDS = ["under", "u35", "young", "20"]
OLD_WORDS = ["over", "o50", "senior", "mature", "60"]

TIER_LOW_WORDS = ["1", "needs", "improve", "low", "poor", "bad"]
TIER_HIGH_WORDS = ["3", "polish", "high", "sartorial", "good", "great", "elegan"]
TIER_MID_WORDS = ["2", "average", "mid", "med", "decent"]

SORTER_FACE_PATH_WORDS = ["face", "hair", "grooming", "beard", "skincare", "amiugly",
                          "eyebrow", "facial", "glowup", "makeup", "headshot", "portrait"]
BATCH_FACE_PATH_WORDS = ["face", "hair", "grooming", "beard", "skincare", "amiugly",
                         "eyebrow", "facial", "makeup", "portrait"]
FACE_FOCUS_WORDS = ["face", "groom"]
SORTER_SHOT_WORDS = ["portrait", "close", "head"]
BATCH_SHOT_WORDS = ["portrait", "head"]

# Judge synonyms: canonical class -> the spellings mapped onto it.
UPPER_JACKET_SPELLINGS = ["suit_jacket", "blazer", "suit"]
UPPER_SYNONYMS = {
    "plain_crewneck_tee": ["t-shirt", "tee", "tshirt"],
    "oxford_button_down": ["button_down", "button_up", "oxford"],
    "casual_blouse": ["blouse"],
}
MID_TROUSER_SPELLINGS = ["suit_pants", "pants", "trousers"]
MID_JACKET_SPELLINGS = ["suit_jacket", "suit_coat", "sport_coat"]
LOWER_SYNONYMS = {
    "tailored_trousers": ["suit_pants", "dress_pants", "slacks", "tailored_pants", "trouser", "trousers"],
    "denim_jeans": ["jeans", "blue_jeans"],
    "athletic_shorts": ["shorts"],
    "chino_pants": ["chinos", "khakis"],
    "casual_skirt": ["skirt"],
}
BATCH_EXTRA_TROUSER_SPELLINGS = ["suit"]
FOOTWEAR_SYNONYMS = {
    "leather_dress_shoes": ["dress_shoes", "loafers", "monk_straps", "derbies", "oxfords"],
    "canvas_sneakers": ["sneakers", "tennis_shoes", "trainers"],
    "heeled_pumps": ["heels", "pumps", "high_heels"],
    "ankle_boots": ["boots"],
    "ballet_flats": ["flats"],
}
# The training loader's own, smaller table: field -> {spelling: class}.
LOADER_FIELDS = ["upper_type", "mid_type", "lower_type", "footwear_type", "formality",
                 "hair_styled", "hair_length", "facial_hair_style", "makeup_style"]
LOADER_SYNONYMS = {
    "lower_type": {"suit": "tailored_trousers", "suit_pants": "tailored_trousers",
                   "slacks": "tailored_trousers", "trousers": "tailored_trousers",
                   "dress_pants": "tailored_trousers", "jeans": "denim_jeans", "blue_jeans": "denim_jeans"},
    "mid_type": {"suit_jacket": "blazer", "suit_coat": "blazer", "sport_coat": "blazer"},
    "upper_type": {"suit": "dress_shirt", "suit_jacket": "dress_shirt"},
    "footwear_type": {"dress_shoes": "leather_dress_shoes", "loafers": "leather_dress_shoes",
                      "oxfords": "leather_dress_shoes", "sneakers": "canvas_sneakers",
                      "tennis_shoes": "canvas_sneakers"},
}

# Image-size gate of the training loaders, (height, width).
GROOMING_INPUT_SIZE = (384, 384)
OUTFIT_INPUT_SIZE = (512, 384)

# Framing gate: orientation -> (min h/w, max h/w).
ASPECT_WINDOWS = {"portrait": (1.20, 2.50), "square": (0.65, 1.85)}
WHITE_CORNER_MEAN = 252

MIN_DOWNLOAD_BYTES = 10_000
KEEP_EXISTING_BYTES = 5_000
KEEP_EXISTING_BYTES_CODED = 3_000

BLOCKED_URL_WORDS = [
    "acne_vulgaris", "dermatology", "skin_disease", "eczema", "psoriasis",
    "anorexia", "plastic_surgery", "rhinoplasty", "bariatric", "weight_loss_surgery",
    "body_dysmorphia", "fat_shaming", "liposuction", "botched", "scarring_alopecia",
    "flatlay", "flat-lay", "ghost-mannequin", "mannequin", "hanger", "packshot",
    "clipart", "vector", "illustration", "drawing", "cartoon", "render3d",
    "movie-poster", "album-cover", "soundtrack", "film-poster", "product-only",
    "blank-t-shirt", "mockup", "isolated-on-white",
]
VIDEO_HINTS = ["hosted:video", "rich:video"]
VIDEO_DOMAINS = ["v.redd.it", "youtube.com", "youtu.be", "tiktok.com", "streamable.com",
                 "redgifs.com", "gfycat.com"]
GONE_MARKS = ["[removed]", "[deleted]"]
HARVEST_SKIPPED_HOSTS = ["google.com", "gstatic.com"]
