"""Garment pools, palette, tiers, condition phrases, label fields."""

TIERS = ["flaw_severe", "flaw_mild", "average", "polished"]
SCORE_BANDS = {"flaw_severe": (1.0, 2.0), "flaw_mild": (2.1, 3.0), "average": (4.0, 6.0), "polished": (7.0, 10.0)}
SEVERITY = {"flaw_severe": 2, "flaw_mild": 1, "average": 0, "polished": 0}
REAL_TIER_RANGES = {"1_Needs_Improvement": (1.0, 3.0), "2_Average": (4.0, 6.0), "3_Polished": (7.0, 10.0)}

CATEGORY_COUNTS = {"Men_Grooming": 6000, "Women_Grooming": 6000, "Men_Outfit": 8000, "Women_Outfit": 8000}
CATEGORIES = list(CATEGORY_COUNTS)
GROOMING_CATEGORIES = ["Men_Grooming", "Women_Grooming"]
OUTFIT_CATEGORIES = ["Men_Outfit", "Women_Outfit"]
RESOLUTION = {"Men_Grooming": "1024x1024", "Women_Grooming": "1024x1024",
              "Men_Outfit": "768x1024", "Women_Outfit": "768x1024"}

# Palette anchors, RGB 0-255, in tie order.
PALETTE = {
    "black": (20, 20, 20), "white": (240, 240, 235), "grey": (130, 130, 132), "navy": (28, 38, 68),
    "blue": (52, 92, 162), "red": (172, 32, 32), "green": (52, 110, 62), "beige": (212, 192, 156),
    "brown": (92, 62, 40), "burgundy": (110, 26, 46),
}
NEUTRALS = ["black", "white", "grey", "beige"]
CLASHING = ("red", "green")
GARMENT_COLORS = {
    "denim_jacket": ["blue", "navy", "black", "grey", "white"],
    "denim_jeans": ["blue", "navy", "black", "grey", "white"],
    "leather_dress_shoes": ["black", "brown"],
    "oxford_shoes": ["black", "brown"],
    "heeled_pumps": ["black", "brown", "burgundy"],
    "pointed_flats": ["black", "brown", "burgundy"],
    "ankle_boots": ["black", "brown"],
}

# Pools: (class, phrase, formality 0-3).
POOLS = {
    ("man", "upper"): [
        ("tank_top", "a tank top", 0), ("graphic_tee", "a graphic t-shirt", 0),
        ("plain_crewneck_tee", "a plain crew-neck t-shirt", 0), ("henley", "a henley shirt", 1),
        ("polo_shirt", "a polo shirt", 1), ("flannel_shirt", "a flannel shirt", 1),
        ("thermal_henley", "a waffle-knit thermal henley", 1), ("crewneck_sweater", "a crewneck sweater", 2),
        ("turtleneck_sweater", "a fine-knit turtleneck sweater", 2),
        ("oxford_button_down", "an oxford button-down shirt", 2),
        ("chambray_shirt", "a chambray button-up shirt", 2), ("dress_shirt", "a dress shirt", 3)],
    ("man", "mid"): [
        ("none", "", 0), ("hoodie", "a pullover hoodie", 0), ("denim_jacket", "a denim jacket", 1),
        ("bomber_jacket", "a bomber jacket", 1), ("cardigan", "a cardigan", 2), ("blazer", "a tailored blazer", 3)],
    ("man", "lower"): [
        ("sweatpants", "sweatpants", 0), ("athletic_shorts", "athletic shorts", 0),
        ("cargo_shorts", "cargo shorts", 0), ("denim_jeans", "denim jeans", 1), ("joggers", "tapered joggers", 1),
        ("cargo_pants", "cargo pants", 1), ("chino_pants", "chino pants", 2),
        ("corduroy_pants", "corduroy pants", 2), ("tailored_trousers", "tailored trousers", 3),
        ("dress_pants", "dress pants", 3)],
    ("man", "footwear"): [
        ("slides", "slide sandals", 0), ("flip_flops", "flip flops", 0), ("canvas_sneakers", "canvas sneakers", 1),
        ("running_shoes", "running shoes", 1), ("leather_sneakers", "minimalist leather sneakers", 2),
        ("suede_desert_boots", "suede desert boots", 2), ("leather_dress_shoes", "leather dress shoes", 3),
        ("oxford_shoes", "oxford shoes", 3)],
    ("woman", "upper"): [
        ("tank_top", "a tank top", 0), ("graphic_tee", "a graphic t-shirt", 0),
        ("casual_camisole", "a casual camisole", 0), ("henley", "a henley top", 1),
        ("casual_blouse", "a casual blouse", 1), ("wrap_top", "a wrap top", 1), ("silk_blouse", "a silk blouse", 2),
        ("fitted_sweater", "a fitted sweater", 2), ("turtleneck_sweater", "a fine-knit turtleneck sweater", 2),
        ("tailored_blouse", "a tailored blouse", 3), ("dress_shirt", "a fitted dress shirt", 3),
        ("dress", "a dress", 3)],
    ("woman", "mid"): [
        ("none", "", 0), ("hoodie", "a pullover hoodie", 0), ("denim_jacket", "a denim jacket", 1),
        ("cropped_jacket", "a cropped jacket", 1), ("cardigan", "a cardigan", 2), ("blazer", "a tailored blazer", 3)],
    ("woman", "lower"): [
        ("sweatpants", "sweatpants", 0), ("leggings", "leggings", 0), ("denim_shorts", "denim shorts", 0),
        ("denim_jeans", "denim jeans", 1), ("joggers", "tapered joggers", 1), ("casual_skirt", "a casual skirt", 1),
        ("wide_leg_trousers", "wide-leg trousers", 2), ("midi_skirt", "a midi skirt", 2),
        ("tailored_trousers", "tailored trousers", 3), ("pencil_skirt", "a pencil skirt", 3)],
    ("woman", "footwear"): [
        ("slides", "slide sandals", 0), ("flip_flops", "flip flops", 0), ("sneakers", "casual sneakers", 1),
        ("ballet_flats", "ballet flats", 1), ("ankle_boots", "ankle boots", 2),
        ("block_heels", "block-heel sandals", 2), ("pointed_flats", "pointed-toe flats", 3),
        ("heeled_pumps", "heeled pumps", 3)],
}
PATTERNS = ["solid", "striped", "checked", "printed"]
UPPER_PATTERN_WEIGHTS = [0.55, 0.16, 0.15, 0.14]
LOWER_PATTERN_WEIGHTS = [0.75, 0.08, 0.10, 0.07]
FORMALITY_CLASSES = ["casual", "smart_casual", "business", "formal"]
FACIAL_HAIR_STYLES = ["clean_shaven", "stubble", "short_beard", "full_beard", "moustache"]
HAIR_LENGTHS = ["buzz_cut", "short", "medium", "long"]
MAKEUP_STYLES = ["none", "minimal", "everyday", "full"]

IDENTITY = {
    "age": ["19-year-old", "22-year-old", "28-year-old", "35-year-old", "45-year-old", "55-year-old"],
    "ethnicity": ["Caucasian", "Black", "East Asian", "South Asian", "Hispanic", "Middle Eastern"],
}
BUILDS = {"man": ["slim", "athletic", "average build", "heavy set", "muscular", "very skinny"],
          "woman": ["slim", "curvy", "athletic", "average build", "plus size"]}
FACE_SHAPES = {
    "man": ["round face, double chin", "strong square jaw, deep set eyes", "sharp angular face, prominent nose",
            "wide flat face", "oval face, high cheekbones", "narrow face, pointed chin"],
    "woman": ["round soft face shape", "long narrow face, prominent cheekbones",
              "high cheekbones, visible age lines", "heart-shaped face", "oval face, defined jawline",
              "square jaw, full cheeks"]}
BACKGROUNDS = [
    ("plain_wall", "standing against a plain neutral-colored wall"),
    ("bedroom", "standing in a bedroom with a bed and dresser visible behind them"),
    ("bathroom_mirror", "standing in front of a bathroom mirror, a faint reflection visible"),
    ("hallway", "standing in a plain apartment hallway"),
    ("living_room", "standing in a living room with a sofa visible behind them"),
    ("office", "standing in a casual office space with desks visible behind them"),
    ("outdoors", "standing outdoors on a city sidewalk with buildings in the background"),
    ("studio", "standing against a seamless studio backdrop")]
LIGHTING = [
    ("window_light", "soft natural window light from the side"),
    ("studio_lighting", "bright even studio lighting"),
    ("warm_overhead", "warm overhead indoor lighting"),
    ("cool_overhead", "cool-toned overhead fluorescent lighting"),
    ("dim", "dim, slightly underexposed indoor lighting"),
    ("slightly_harsh", "slightly harsh direct on-camera flash lighting"),
    ("overcast", "soft overcast daylight"),
    ("evening_lamp", "warm evening lamp lighting")]
FRAMING = [
    ("centered", "centered in frame, straight-on eye-level angle"),
    ("slightly_off_center", "slightly off-center in frame, straight-on eye-level angle"),
    ("slightly_low_angle", "centered in frame, slightly low camera angle"),
    ("slightly_high_angle", "centered in frame, slightly high camera angle")]
OUTFIT_HAIR = [
    "short black hair", "long brown hair tied back", "shoulder-length blonde hair", "short red hair",
    "long dark hair worn loose", "cropped grey hair", "medium-length brown hair", "long black hair in a ponytail",
    "short auburn hair", "curly dark hair", "straight platinum blonde hair", "short salt-and-pepper hair"]

# Condition phrases by tier, in the order of TIERS.
FABRIC_PHRASES = [
    "deeply wrinkled with visible crease lines, plus a coin-sized dried stain near the hem",
    "noticeably creased, as if pulled straight out of a laundry hamper",
    "clean and reasonably smooth, unremarkable",
    "crisp and freshly pressed, with no visible wrinkles"]
LOWER_SEVERE_FABRIC_PHRASE = "deeply wrinkled with visible crease lines and rumpled fabric"
FIT_PHRASES = {
    "baggy": ["hanging noticeably loose and bunching, several sizes too large",
              "a bit loose through the body, clearly not tailored",
              "a standard, unremarkable fit, neither baggy nor tight",
              "tailored to the body with clean, flattering proportions"],
    "tight": ["uncomfortably tight and straining across the body, clearly a size too small",
              "a little snug through the body, clearly not tailored",
              "a standard, unremarkable fit, neither baggy nor tight",
              "tailored to the body with clean, flattering proportions"]}
FOOTWEAR_PHRASES = {
    True: ["visibly scuffed and dirty, with the laces untied", "a bit worn and scuffed",
           "plain and clean, unremarkable", "clean and freshly polished"],
    False: ["visibly scuffed, worn down, and dirty", "a bit worn and scuffed",
            "plain and clean, unremarkable", "clean and freshly polished"]}
LACED_FOOTWEAR = ["canvas_sneakers", "running_shoes", "leather_sneakers", "suede_desert_boots",
                  "oxford_shoes", "leather_dress_shoes", "sneakers", "ankle_boots"]
STYLING_PHRASES = [
    "the whole outfit looking sloppy and thrown-together, with no thought given to how the pieces work together",
    "the outfit looking like not much thought went into how it was put together",
    "an ordinary, unremarkable overall look, neither sloppy nor especially put-together",
    "the whole outfit looking sharp and intentionally put together"]
MID_PHRASES = ["looking worn and neglected", "a bit rumpled", "in ordinary condition", "crisp and well-kept"]
HAIR_LENGTH_WORDS = {"buzz_cut": "very short buzzed hair", "short": "short hair",
                     "medium": "medium-length hair", "long": "long hair"}
HAIR_PHRASES = {
    "man": ["visibly greasy and unwashed, strands clumped together with an oily sheen, flattened against the scalp",
            "flat and unbrushed with no styling, clearly not styled today",
            "lying naturally with no product, neither messy nor styled",
            "neatly styled with a touch of product, clean and intentional"],
    "woman": ["visibly greasy and unwashed, an oily sheen at the roots, strands clumped and flattened",
              "tangled and unbrushed, with visible frizz sticking out unevenly",
              "worn plainly with no product", "smooth and styled with visible shine"]}
FACIAL_HAIR_WORDS = {"stubble": "light stubble", "short_beard": "a short beard",
                     "full_beard": "a full beard", "moustache": "a moustache"}
FACIAL_HAIR_PHRASES = [
    "growing in patchy, uneven clumps with bare skin gaps between patches, unkempt",
    "growing in with an uneven length and no defined edge or lineup",
    "an ordinary, unremarkable trim with no defined lineup", "precisely trimmed with crisp, clean edges"]
MAKEUP_WORDS = {"minimal": "minimal makeup", "everyday": "everyday makeup", "full": "a full face of makeup"}
MAKEUP_PHRASES = [
    "applied unevenly with two clashing colors and visibly smudged edges", "slightly smudged and unevenly blended",
    "applied simply with no particular effort", "flawlessly blended with precise, clean application"]
SKIN_PHRASES = [
    "dry, visibly flaking skin with rough patches on the forehead and around the nose",
    "a dull, uneven skin tone with visible tiredness under the eyes",
    "ordinary skin texture with a few small visible pores",
    "smooth, evenly hydrated skin with a healthy natural glow"]
EYEBROW_PHRASES = [
    "thick and completely unshaped, growing together above the nose",
    "a few stray long hairs among otherwise ordinary eyebrows",
    "natural and unshaped, neither groomed nor unkempt", "neatly shaped with clean, defined edges"]
NEGATIVE_PROMPT = (
    "deformed hands, extra fingers, fused fingers, extra limbs, missing limbs, "
    "multiple people, cropped head, cropped feet, out of frame, "
    "text, watermark, logo, signature, cartoon, 3d render, plastic skin, airbrushed skin, "
    "blurry, low quality, distorted proportions")
CLEAN_SHAVEN_NEGATIVE = "stubble, beard, mustache, five oclock shadow, facial hair, goatee, sideburns, unshaven"
SOLID_NEGATIVE = ("striped pattern, checked pattern, plaid, printed pattern, patterned fabric, "
                  "print design, graphic print")
SKIN_SEVERE_NEGATIVE = ("smooth skin, healthy glowing skin, clear skin, hydrated skin, flawless skin, even skin tone")
MAKEUP_SEVERE_POSITIVE = (
    "The makeup shows two clashing colors. Two mismatched, non-complementary makeup colors are visibly applied "
    "together -- a color clash, badly coordinated makeup colors, uneven smudged application.")
EYEBROWS_SEVERE_POSITIVE = (
    "The eyebrows are thick and grow together above the nose bridge, forming a connected unibrow with no visible "
    "gap between them.")

# Label fields by category kind: (name, type, classes-or-None, loss weight).
BINARY = ["0", "1"]
GROOMING_FIELDS = [
    ("hair_untidy", "ordinal", None, 0.3), ("hair_styled", "categorical", BINARY, 0.3),
    ("hair_length", "categorical", HAIR_LENGTHS, 0.3), ("skin_neglected", "ordinal", None, 0.3),
    ("skin_healthy", "categorical", BINARY, 0.3), ("eyebrows_unkempt", "ordinal", None, 0.3),
    ("eyebrows_groomed", "categorical", BINARY, 0.3)]
MEN_GROOMING_FIELDS = [
    ("facial_hair_style", "categorical", FACIAL_HAIR_STYLES, 0.3), ("facial_hair_untidy", "ordinal", None, 0.3),
    ("facial_hair_groomed", "categorical", BINARY, 0.3)]
WOMEN_GROOMING_FIELDS = [
    ("makeup_style", "categorical", MAKEUP_STYLES, 0.3), ("makeup_uneven", "ordinal", None, 0.3),
    ("makeup_flawless", "categorical", BINARY, 0.3)]
OUTFIT_CONDITION_FIELDS = [
    ("fit_baggy", "ordinal", None, 0.3), ("fit_tight", "ordinal", None, 0.3),
    ("fit_tailored", "categorical", BINARY, 0.3), ("fabric_wrinkled", "ordinal", None, 0.3),
    ("fabric_crisp", "categorical", BINARY, 0.3), ("footwear_worn", "ordinal", None, 0.3),
    ("footwear_polished", "categorical", BINARY, 0.3), ("styling_sloppy", "ordinal", None, 0.3),
    ("styling_sharp", "categorical", BINARY, 0.3)]
SCENE_META = ["requested_background", "requested_lighting", "requested_framing"]
OUTFIT_META = (["requested_upper_color", "requested_mid_color", "requested_lower_color",
                "requested_footwear_color"] + SCENE_META + ["requested_hair_desc"])


def gender_of(category: str) -> str:
    return "woman" if category.startswith("Women") else "man"


def kind_of(category: str) -> str:
    return "grooming" if category.endswith("Grooming") else "outfit"


def classes_of(gender: str, slot: str) -> list[str]:
    return [name for name, _, _ in POOLS[(gender, slot)]]


def label_schema(category: str) -> list[dict]:
    """Ordered label fields of a category: score, heads, then provenance-only meta fields."""
    gender = gender_of(category)
    fields = [("score", "regression", None, 1.0)]
    if kind_of(category) == "grooming":
        fields += GROOMING_FIELDS + (MEN_GROOMING_FIELDS if gender == "man" else WOMEN_GROOMING_FIELDS)
        meta = SCENE_META
    else:
        fields += [
            ("upper_type", "categorical", classes_of(gender, "upper"), 0.3),
            ("upper_pattern", "categorical", PATTERNS, 0.3),
            ("mid_type", "categorical", classes_of(gender, "mid"), 0.3),
            ("lower_type", "categorical", classes_of(gender, "lower") + ["none"], 0.3),
            ("lower_pattern", "categorical", PATTERNS + ["none"], 0.3),
            ("footwear_type", "categorical", classes_of(gender, "footwear"), 0.3),
            ("formality", "categorical", FORMALITY_CLASSES, 0.5)] + OUTFIT_CONDITION_FIELDS
        meta = OUTFIT_META
    out = []
    for name, kind, classes, weight in fields:
        entry = {"name": name, "type": kind, "loss_weight": weight}
        if kind == "ordinal":
            entry["levels"] = 3
        if kind == "categorical":
            entry["classes"] = list(classes)
        out.append(entry)
    return out + [{"name": name, "type": "meta"} for name in meta]


def schema_columns(category: str) -> list[str]:
    return ["filename", "category", "tier"] + [f["name"] for f in label_schema(category)]


# Pixel gates of the measurement job.
MIN_BLUR_VARIANCE = 40.0
BRIGHTNESS_RANGE = (35, 225)
FEET_BAND_STD_MIN = 8.0
QA_PASS_RATE_WARN = 0.85
TORSO_BAND = (0.36, 0.26, 0.64, 0.45)
LEGS_BAND = (0.40, 0.58, 0.60, 0.78)
COLOR_MATCH_GATE = 0.70
GARMENT_GATE = 0.80
PATTERN_GATE = 0.65
THIN_CLASS = 250

# Progress slices of the planned work, [start, end).
HOST_SLICES = [("original", 0, 4810), ("vast1", 4810, 10000), ("vast4", 10000, 13000),
               ("vast3", 13000, 16000), ("vast2", 16000, 28000)]
STALL_ALERT_HOURS = 0.5
