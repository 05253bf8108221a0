"""Photo keyword vocabularies and portrait description patterns."""

EXCLUDED_TERMS = [
    "animal", "dog", "cat", "puppy", "kitten", "canine", "feline", "pet", "pets",
    "mammal", "wildlife", "bird", "birds", "horse", "horses", "bear", "lion", "tiger",
    "wolf", "fox", "deer", "duck", "ducks", "sheep", "cow", "cattle", "elephant",
    "monkey", "ape", "fish", "shark", "whale", "dolphin", "insect", "spider",
    "butterfly", "reptile", "snake", "lizard", "amphibian", "frog", "fauna",
    "baby", "infant", "toddler", "newborn", "kid", "child", "children", "preschooler",
    "boyhood", "girlhood",
    "flower", "flowers", "blossom", "petal", "rose", "tulip", "succulent", "cactus",
    "tree trunk", "leaf", "plant", "forest", "woodland", "mountain", "mountains",
    "valley", "canyon", "volcano", "glacier", "iceberg", "waterfall", "desert dune",
    "sand dune", "galaxy", "milky way", "nebula", "astronomy", "moon", "eclipse", "underwater",
    "building", "buildings", "skyscraper", "architecture", "interior design",
    "living room", "bedroom", "kitchen", "bathroom", "furniture", "table", "chair",
    "couch", "sofa", "desk", "lamp", "car", "automobile", "vehicle", "vehicles",
    "truck", "bus", "motorcycle", "bicycle", "airplane", "aircraft", "helicopter",
    "boat", "ship", "yacht", "train", "locomotive",
    "food", "dish", "meal", "fruit", "vegetable", "coffee cup", "drink", "cocktail",
    "pizza", "burger", "cake", "dessert", "laptop", "computer", "keyboard",
    "monitor", "smartphone", "iphone", "macbook", "gadget",
    "texture", "abstract", "wallpaper", "flatlay", "flat lay", "still life",
    "product mockup", "graphic", "illustration", "3d render", "render",
]
HUMAN_TERMS = ["person", "human", "people", "man", "woman", "girl", "boy", "guy", "male",
               "female", "model", "adult", "portrait", "individual", "lady", "gentleman"]
MALE_TERMS = ["man", "male", "guy", "gentleman", "menswear", "men's fashion", "men fashion", "businessman",
              "groom", "him", "he", "bearded man", "beard", "mustache", "stubble", "tuxedo"]
FEMALE_TERMS = ["woman", "female", "girl", "lady", "womenswear", "women's fashion", "women fashion",
                "businesswoman", "bride", "her", "she", "dress", "gown", "skirt", "blouse", "sundress",
                "evening dress", "cocktail dress", "wedding gown", "heels", "high heels"]
FACE_TERMS = ["face", "portrait", "headshot", "facial hair", "beard", "mustache", "stubble", "hair", "hairstyle",
              "haircut", "skin", "eyes", "smile", "jawline", "eyebrows", "clean shaven", "sideburns", "pompadour",
              "fade haircut", "makeup", "lips", "facial expression", "close up portrait", "beauty portrait",
              "head shot"]
FASHION_TERMS = ["fashion", "clothing", "apparel", "outfit", "suit", "blazer", "tuxedo", "dress", "gown", "skirt",
                 "blouse", "jacket", "coat", "overcoat", "t-shirt", "shirt", "jeans", "trousers", "pants",
                 "streetwear", "style", "formal wear", "casual wear", "attire", "garment", "hoodie", "sweater",
                 "cardigan", "trench coat", "leather jacket", "denim jacket", "lookbook", "runway", "sundress",
                 "evening dress", "cocktail dress", "vest", "tie", "necktie", "bow tie", "smart casual",
                 "business attire", "stylish", "fashion model", "denim"]
POSTURE_TERMS = ["full body", "standing", "posture", "standing portrait", "pose", "model posing", "walking",
                 "stride", "fit check", "runway walk", "standing tall", "full length"]

NEGATIVE_PHRASES = ["dog", "cat", "puppy", "kitten", "pet", "animal", "bird", "horse", "bear", "wildlife",
                    "macro photography", "landscape photography of", "body of water near", "close up of flower",
                    "silhouette of trees", "view of mountains", "scenic view", "interior of room",
                    "aerial photography", "empty street", "still life", "baby", "infant", "toddler",
                    "little girl", "little boy", "kid"]
HUMAN_PHRASES = ["person", "human", "man", "woman", "girl", "boy", "model", "wearing", "outfit", "portrait",
                 "face", "standing"]
MALE_PHRASES = ["man", "men", "guy", "male", "gentleman", "boy", "groom", "businessman", "beard"]
FEMALE_PHRASES = ["woman", "women", "girl", "female", "lady", "bride", "businesswoman", "dress", "gown", "skirt"]
FACE_PHRASES = ["portrait", "face", "headshot", "hair", "beard", "mustache", "eyes", "smile", "grooming",
                "jawline", "stubble"]
FASHION_PHRASES = ["suit", "dress", "outfit", "jacket", "coat", "blazer", "t-shirt", "shirt", "jeans", "wearing",
                   "fashion", "streetwear", "style", "gown", "skirt", "attire", "tuxedo"]
POSTURE_PHRASES = ["standing", "full body", "posture", "pose", "walking", "posing", "runway"]
PHOTO_ASPECT_RANGE = (0.35, 2.6)
PHOTO_MIN_EDGE = 480

# Portrait descriptions: reject words, then word-boundary alternations per flag.
LOW_QUALITY_PHRASES = ["blurry", "distorted", "grainy", "low quality", "out of focus"]
DESCRIPTION_FLAGS = {
    "male": "man|men|male|guy|gentleman|boy|actor|businessman|groom|him|he",
    "female": "woman|women|female|girl|lady|actress|businesswoman|bride|pageant|her|she",
    "mature": ("middle-aged|mature|older|senior|elderly|gray hair|grey hair|silver hair|white hair|white beard|"
               "gray beard|grey beard|40s|50s|60s|wrinkles"),
    "gray": "gray hair|grey hair|silver hair|white hair|white beard|gray beard|grey beard",
    "beard": "beard|bearded|goatee|mustache|stubble|facial hair|5 o'clock shadow|sideburns",
    "bald": "bald|balding|receding hairline|shaved head|thinning hair",
    "styled": ("styled hair|wavy hair|curly hair|blonde hair|blond hair|brown hair|black hair|brunette|bun|"
               "ponytail|bangs|short hair|long hair|bob haircut"),
    "makeup": "makeup|lipstick|glam|eyeliner|eyeshadow|gloss|mascara",
    "smile": "smile|smiling|smiles|cheerful|laughing|grin",
    "glasses": "glasses|eyeglasses|sunglasses|spectacles",
    "formal": "suit|blazer|tuxedo|formal|tie|necktie|bow tie|gown|evening dress|tux",
}

AGE_NAMES = ["0-2", "3-9", "10-19", "20-29", "30-39", "40-49", "50-59", "60-69", "70+"]
GENDER_NAMES = ["Male", "Female"]
RACE_NAMES = ["East Asian", "Indian", "Black", "White", "Middle Eastern", "Latino_Hispanic", "Southeast Asian"]
