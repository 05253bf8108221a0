"""Advice-text gates, occasions, domain words, tag fields, look scoring."""

MIN_WORDS = 25
MAX_WORDS = 85
MAX_LINE_WORDS = 16
MAX_SEQUENCE = 512

BANNED_PATTERNS = [
    r"\blose weight\b", r"\bweight loss\b", r"\blosing weight\b", r"\bdiet\b", r"\bcalorie", r"\bslim down\b",
    r"\bslimmer\b", r"\bclear up (your|the) skin\b", r"\backne\b", r"\bpimple", r"\bbody shape\b",
    r"\bchange your body\b", r"\bplastic surgery\b", r"\bbotox\b", r"\btone (your|the) (body|muscles?)\b",
    r"\bwork ?out to\b"]
UNOBSERVABLE_PATTERNS = [r"\bcologne\b", r"\bperfume\b", r"\bfragrance\b", r"\bdeodorant\b", r"\bscent\b"]
# A part of every phrase above, lower case.
BANNED_STEMS = ["weight", "diet", "calorie", "slim", "skin", "acne", "pimple", "body", "surgery", "botox", "tone", "work"]
UNOBSERVABLE_STEMS = ["cologne", "perfume", "fragrance", "deodorant", "scent"]
CHATTER_OPENERS = ["sure", "here's", "here is", "as a stylist", "certainly", "of course", "i'd suggest",
                   "i would suggest", "great question", "absolutely"]
ACTION_VERBS = ["cuff", "tuck", "roll", "unbutton", "button", "iron", "steam", "press", "trim", "shave",
                "size down", "size up", "swap", "tie", "polish", "shine", "brush", "comb", "style", "layer",
                "untuck", "hem", "belt", "wash", "moisturize", "line up", "clean up", "shorten", "lengthen",
                "straighten", "align", "adjust", "replace", "pair", "smooth", "square", "correct", "add", "edge",
                "apply", "balance"]
NO_VERB_WARNING = "WARNING: no recognizable actionable verb -- review for vagueness"

POSTURES = ["upright_aligned", "slight_slouch", "lateral_lean", "shoulders_uneven"]
LIGHTINGS = ["well_lit", "dim_overhead", "harsh_shadows", "soft_window_light"]
HARMONIES = ["classic_contrast", "monochromatic_neutral", "clashing_tones", "earthy_analogous",
             "complementary_pop"]
# Signal draws by tier: [(value, weight)].
POSTURE_WEIGHTS = {
    "polished": [("upright_aligned", 0.75), ("slight_slouch", 0.25)],
    "average": [("upright_aligned", 0.45), ("slight_slouch", 0.35), ("shoulders_uneven", 0.20)],
    "flaw_mild": [("slight_slouch", 0.40), ("shoulders_uneven", 0.30), ("lateral_lean", 0.20),
                  ("upright_aligned", 0.10)],
    "flaw_severe": [("slight_slouch", 0.35), ("lateral_lean", 0.35), ("shoulders_uneven", 0.30)]}
HARMONY_WEIGHTS = {
    "polished": [("classic_contrast", 0.40), ("monochromatic_neutral", 0.35), ("complementary_pop", 0.25)],
    "average": [("classic_contrast", 0.30), ("earthy_analogous", 0.30), ("monochromatic_neutral", 0.25),
                ("clashing_tones", 0.15)],
    "flaw_mild": [("clashing_tones", 0.45), ("earthy_analogous", 0.30), ("classic_contrast", 0.15),
                  ("monochromatic_neutral", 0.10)],
    "flaw_severe": [("clashing_tones", 0.65), ("earthy_analogous", 0.20), ("classic_contrast", 0.15)]}
LIGHTING_WEIGHTS = [("well_lit", 0.4), ("soft_window_light", 0.3), ("dim_overhead", 0.15), ("harsh_shadows", 0.15)]

OCCASIONS = ["Casual Dinner", "First Date", "Tech Job Interview", "Summer Wedding", "Everyday Errands",
             "Formal Business Meeting", "Night Out", "Gym / Athleisure", "Creative Field Interview",
             "Family Gathering"]
DEFAULT_OCCASION = "Casual Dinner"
# Ordered keyword rules, first hit wins.
OCCASION_RULES = [
    ("Tech Job Interview", ["tech job interview", "tech interview", "coding interview", "software interview"]),
    ("Creative Field Interview", ["creative field interview", "creative interview", "design interview",
                                  "portfolio interview"]),
    ("Tech Job Interview", ["interview", "job interview"]),
    ("Formal Business Meeting", ["formal business meeting", "business meeting", "corporate", "board meeting",
                                 "conference", "client meeting", "business"]),
    ("Everyday Errands", ["casual everyday", "everyday errands", "errands", "casual day", "groceries", "daily",
                          "weekend errands"]),
    ("First Date", ["date night", "first date", "romantic dinner", "date", "romantic"]),
    ("Night Out", ["night out", "party", "club", "cocktail party", "cocktails", "bar", "drinks", "rave", "gala"]),
    ("Gym / Athleisure", ["gym / athleisure", "gym", "athleisure", "workout", "fitness", "training", "sports",
                          "running"]),
    ("Summer Wedding", ["summer wedding", "wedding", "wedding guest", "reception", "formal event"]),
    ("Family Gathering", ["family gathering", "family reunion", "bbq", "thanksgiving", "christmas",
                          "holiday dinner", "family"]),
    ("Casual Dinner", ["casual dinner", "dinner", "lunch", "brunch", "dining", "restaurant", "casual"])]
APP_OCCASION_RULES = [
    ("Tech Job Interview", ["tech", "coding", "software"]),
    ("Creative Field Interview", ["creative", "design", "portfolio"]),
    ("Tech Job Interview", ["interview"]),
    ("Formal Business Meeting", ["business", "meeting", "corporate", "office"]),
    ("Everyday Errands", ["errand", "daily", "casual everyday", "groceries"]),
    ("First Date", ["date", "romantic"]),
    ("Night Out", ["night", "party", "club", "drinks", "cocktail"]),
    ("Gym / Athleisure", ["gym", "workout", "fitness", "athletic"]),
    ("Summer Wedding", ["wedding", "formal event", "reception"]),
    ("Family Gathering", ["family", "reunion", "bbq"])]

OUTFIT_WORDS = [
    "shoe", "shoes", "sneaker", "sneakers", "boot", "boots", "heel", "heels", "loafer", "loafers", "oxford",
    "oxfords", "pump", "pumps", "footwear", "belt", "belts", "buckle", "blazer", "blazers", "jacket", "jackets",
    "suit", "suits", "coat", "coats", "shirt", "shirts", "t-shirt", "t-shirts", "tee", "tees", "polo", "polos",
    "top", "tops", "shoulder", "shoulders", "trousers", "pants", "jeans", "denim", "chinos", "shorts", "skirt",
    "skirts", "dress", "dresses", "socks", "tie", "ties", "cufflinks", "cuff", "cuffs", "collar", "collars",
    "hem", "hems", "sleeves", "tuck", "tucked", "tucking", "steaming", "steam", "ironing", "iron", "outfit",
    "outfits", "clothing", "clothes", "garment", "garments", "blouse", "blouses", "sweater", "sweaters",
    "hoodie", "hoodies", "cardigan", "cardigans", "attire", "outerwear", "apparel", "wardrobe", "lapel",
    "lapels", "waistline"]
GROOMING_WORDS = [
    "shave", "shaving", "razor", "beard", "mustache", "stubble", "facial hair", "mascara", "lipstick", "eyebrow",
    "eyebrows", "brows", "skincare", "skin routine", "haircut", "comb hair", "brush hair", "pomade",
    "styling clay", "cleanser", "moisturizer"]
APP_OUTFIT_WORDS = [
    "shoe", "shoes", "sneaker", "sneakers", "boot", "boots", "heel", "heels", "loafer", "loafers", "oxford",
    "oxfords", "pump", "pumps", "footwear", "belt", "belts", "buckle", "blazer", "blazers", "jacket", "jackets",
    "suit", "suits", "coat", "coats", "shirt", "shirts", "tee", "tees", "polo", "top", "tops", "shoulder",
    "shoulders", "trousers", "pants", "jeans", "denim", "chinos", "shorts", "skirt", "skirts", "dress",
    "dresses", "socks", "tie", "ties", "cufflinks", "cuff", "cuffs", "collar", "collars", "hem", "hems",
    "sleeves", "tuck", "tucked", "tucking", "steaming", "steam", "ironing", "iron", "outfit", "clothing",
    "clothes", "garment", "garments", "blouse", "sweater", "hoodie", "cardigan"]
APP_GROOMING_WORDS = [
    "shave", "shaving", "razor", "beard", "mustache", "stubble", "facial hair", "mascara", "lipstick", "eyebrow",
    "eyebrows", "brows", "skincare", "haircut", "comb hair", "brush hair", "pomade", "styling clay", "cleanser",
    "moisturizer"]
# Fallback lines by (domain, high score).
FALLBACK_LINES = {
    ("men", True): ["• Apply a lightweight matte styling cream or clay to tame any subtle flyaways.",
                    "• Keep facial hair line precisely defined and moisturize skin for a healthy finish."],
    ("men", False): ["• Tidy up the neckline and sideburns with a trimmer to sharpen your profile.",
                     "• Work a dab of pomade or styling paste into hair for intentional shape and hold."],
    ("women", True): ["• Smooth hairline flyaways with a light finishing serum or edge brush.",
                      "• Set brows with a clear brow gel and apply a nourishing lip balm for a polished glow."],
    ("women", False): ["• Brush and shape eyebrows, setting them lightly with a brow gel.",
                       "• Style hair to reduce flyaways and add clean texture or volume."],
    ("outfit", True): ["• Ensure garments remain crisp and unwrinkled throughout the occasion.",
                       "• Keep footwear clean and maintain clean posture for a polished silhouette."],
    ("outfit", False): ["• Steam or iron garments to eliminate wrinkles and sharpen the silhouette.",
                        "• Adjust fit and proportions to ensure clean drape and structured lines."]}
APP_FALLBACK_LINES = {
    ("men", True): ["Apply a lightweight matte styling cream or clay to tame flyaways.",
                    "Keep facial hair lines precisely defined and moisturize skin."],
    ("men", False): ["Tidy up the neckline and sideburns with a precision trimmer.",
                     "Work a dab of pomade or styling paste into hair for intentional hold."],
    ("women", True): ["Smooth hairline flyaways with a light finishing serum or edge brush.",
                      "Set brows with clear gel and apply a nourishing lip balm for a clean glow."],
    ("women", False): ["Brush and shape eyebrows, setting them lightly with a brow gel.",
                       "Style hair to reduce flyaways and add clean texture or volume."],
    ("outfit", True): ["Ensure garments remain crisp and unwrinkled throughout the occasion.",
                       "Keep footwear clean and maintain clean posture for a polished silhouette."],
    ("outfit", False): ["Steam or iron garments to eliminate wrinkles and sharpen the silhouette.",
                        "Adjust fit and proportions to ensure clean drape and structured lines."]}
FALLBACK_SCORE = 7.5

OUTFIT_DEFECTS = ["fabric_wrinkled", "fit_baggy", "fit_tight", "footwear_worn", "styling_sloppy"]
GROOMING_DEFECTS = ["hair_untidy", "skin_neglected", "eyebrows_unkempt"]
MEN_DEFECT = "facial_hair_untidy"
WOMEN_DEFECT = "makeup_uneven"

# Tag-format words that every vocabulary must keep.
TAG_WORDS = [
    "top", "outer", "bottoms", "shoes", "hair", "skin", "eyebrows", "facial_hair", "makeup", "priority_defect",
    "overall_score", "occasion", "gender", "vibe", "tags", "formality", "pattern", "none", "male", "female",
    "casual", "polished", "posture", "lighting", "color_harmony", "fit", "fabric", "footwear_condition",
    "baggy_level", "tight_level", "tailored", "wrinkled_level", "crisp", "worn_level", "system", "user",
    "assistant"]

# Suggestions from predictions: text of each rule.
SUGGEST_HAIR_STYLED = "Style hair with a matte pomade or styling cream for intentional shape."
SUGGEST_HAIR_UNTIDY = "Tame flyaways and stray hairline strands with a touch of finishing balm."
SUGGEST_BEARD = "Clean up and define beard cheeklines and neckline with a trimmer."
SUGGEST_EYEBROWS = "Groom and set eyebrows upward with a spoolie brush."
SUGGEST_HYDRATE = "Hydrate face with a lightweight daily moisturizer for a refreshed look."
SUGGEST_STEAM = "Steam or press garments to remove visible creases before leaving."
SUGGEST_FOOTWEAR = "Clean and wipe footwear along sole edges for a crisp finish."
SUGGEST_LAYER = "Layer with a structured overshirt or casual jacket to elevate the dinner look."
SUGGEST_SWAP = "Swap canvas sneakers for clean leather sneakers or loafers."
SUGGEST_BREAK = "Ensure trousers have a clean break above shoes with no excess pooling."
SUGGESTION_TITLES = [
    ("Hairline & Shape", ["hair", "flyaways"]), ("Facial Hair Lineup", ["beard", "trimmer", "shaven"]),
    ("De-Wrinkle Garments", ["steam", "wrinkle"]), ("Footwear Polish", ["shoe", "sneaker", "footwear"]),
    ("Brow Definition", ["eyebrow", "brows"]), ("Layering Accent", ["layer", "jacket", "blazer"])]
SUGGESTION_TITLE_DEFAULT = "Styling Alignment"
SUGGESTION_GROUPS = [
    ("Hair Styling", ["hair"]), ("Grooming Lineup", ["beard", "trimmer"]), ("Fabric Care", ["steam", "wrinkle"]),
    ("Footwear", ["shoe", "sneaker", "footwear"]), ("Brow Grooming", ["brow"])]
SUGGESTION_ICONS = {"Hair Styling": "comb.fill", "Grooming Lineup": "mustache.fill", "Fabric Care": "sparkles",
                    "Footwear": "shoeprints.fill", "Brow Grooming": "eye.fill"}

# Tweak categories: impact and icon by first keyword hit.
TWEAK_IMPACT = [(0.6, ["posture"]), (0.5, ["groom", "hair"]), (0.5, ["collar", "fit", "tailor"]), (0.4, ["light"])]
TWEAK_IMPACT_DEFAULT = 0.4
TWEAK_ICONS = [
    ("tshirt.fill", ["collar", "lapel"]), ("figure.stand", ["posture", "back"]), ("shoe.fill", ["shoe", "foot"]),
    ("watch.analog", ["acces", "watch"]), ("comb.fill", ["hair", "groom"]),
    ("paintpalette.fill", ["color", "colour"]), ("sun.max.fill", ["light"]), ("scissors", ["fit", "tailor"])]
TWEAK_ICON_DEFAULT = "sparkles"
TWEAK_COLORS = [
    ("purple", ["collar", "fit", "tailor"]), ("blue", ["posture"]), ("green", ["hair", "groom"]),
    ("yellow", ["light"]), ("orange", ["color", "colour"]), ("cyan", ["acces"])]
TWEAK_COLOR_DEFAULT = "gray"

# Look scoring: occasion -> (display name, baseline, posture, fit, formality weight).
OCCASION_PROFILES = {
    "formalEvent": ("Formal Event", 6.8, 7.2, 7.0, 1.6),
    "businessMeeting": ("Business Meeting", 7.0, 7.2, 7.2, 1.3),
    "dateNight": ("Date Night", 7.4, 7.0, 7.2, 0.9),
    "casualEveryday": ("Casual Everyday", 7.6, 7.0, 7.0, 0.5),
    "custom": ("Custom", 7.5, 7.0, 7.0, 0.6)}
FORMAL_OCCASIONS = ["businessMeeting", "formalEvent"]
DEFAULT_TAGS = {
    "businessMeeting": ["Formal", "Confident", "Sharp"], "dateNight": ["Romantic", "Stylish", "Elegant"],
    "casualEveryday": ["Relaxed", "Clean", "Versatile"], "formalEvent": ["Black Tie", "Structured", "Polished"],
    "custom": ["Curated", "Modern", "Distinct"]}
HEADLINES = [(9.3, "Executive & Flawless"), (8.5, "Sharp & Polished"), (7.8, "Well-Put-Together"),
             (7.0, "Clean & Casual")]
HEADLINE_DEFAULT = "Needs a Few Tweaks"
BEARD_CLASSES = ["beard", "mustache", "afro", "curls"]
EYEWEAR_CLASSES = ["sunglass", "glasses", "spectacles", "eyewear"]
FORMAL_CLASSES = ["suit", "blazer", "tie", "jacket", "shirt", "collar", "dress"]
CASUAL_CLASSES = ["t-shirt", "hoodie", "sweater", "jersey", "denim"]
SIGNATURE_WEIGHTS = [1.4, 1.4, 1.1, 1.0, 1.0, 1.1]
