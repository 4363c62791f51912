"""Fixed values that must equal the reference's for equal results.

These are data, not logic: each list is kept in its natural order and in
plain text. Operators take them as default arguments and accept others.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: locality canonicalisation, round 1 (applied in this order,
# as literal substring replacements; order matters).
# ---------------------------------------------------------------------------
LOCALITY_RULES_ROUND1 = [
    ("dharam colony", "sector 12"),
    ("krishna colony", "sector 7"),
    ("suncity", "sector 54"),
    ("prem nagar", "sector 13"),
    ("mg road", "sector 28"),
    ("gandhi nagar", "sector 28"),
    ("laxmi garden", "sector 11"),
    ("shakti nagar", "sector 11"),
    ("baldev nagar", "sector 7"),
    ("shivpuri", "sector 7"),
    ("garhi harsaru", "sector 17"),
    ("imt manesar", "manesar"),
    ("adarsh nagar", "sector 12"),
    ("shivaji nagar", "sector 11"),
    ("bhim nagar", "sector 6"),
    ("madanpuri", "sector 7"),
    ("saraswati vihar", "sector 28"),
    ("arjun nagar", "sector 8"),
    ("ravi nagar", "sector 9"),
    ("vishnu garden", "sector 105"),
    ("bhondsi", "sector 11"),
    ("surya vihar", "sector 21"),
    ("devilal colony", "sector 9"),
    ("valley view estate", "gwal pahari"),
    ("mehrauli  road", "sector 14"),
    ("jyoti park", "sector 7"),
    ("ansal plaza", "sector 23"),
    ("dayanand colony", "sector 6"),
    ("sushant lok phase 2", "sector 55"),
    ("chakkarpur", "sector 28"),
    ("greenwood city", "sector 45"),
    ("subhash nagar", "sector 12"),
    ("sohna road road", "sohna road"),
    ("malibu town", "sector 47"),
    ("surat nagar 1", "sector 104"),
    ("new colony", "sector 7"),
    ("mianwali colony", "sector 12"),
    ("jacobpura", "sector 12"),
    ("rajiv nagar", "sector 13"),
    ("ashok vihar", "sector 3"),
    ("dlf phase 1", "sector 26"),
    ("nirvana country", "sector 50"),
    ("palam vihar", "sector 2"),
    ("dlf phase 2", "sector 25"),
    ("sushant lok phase 1", "sector 43"),
    ("laxman vihar", "sector 4"),
    ("dlf phase 4", "sector 28"),
    ("dlf phase 3", "sector 24"),
    ("sushant lok phase 3", "sector 57"),
    ("dlf phase 5", "sector 43"),
    ("rajendra park", "sector 105"),
    ("uppals southend", "sector 49"),
    ("sohna", "sohna road"),
    ("ashok vihar phase 3 extension", "sector 5"),
    ("south city 1", "sector 41"),
    ("ashok vihar phase 2", "sector 5"),
]

# FIXED VALUES: locality canonicalisation, round 2 (after the frequency filter).
LOCALITY_RULES_ROUND2 = [
    ("sector 95a", "sector 95"),
    ("sector 23a", "sector 23"),
    ("sector 12a", "sector 12"),
    ("sector 3a", "sector 3"),
    ("sector 110 a", "sector 110"),
    ("patel nagar", "sector 15"),
    ("a block sector 43", "sector 43"),
    ("maruti kunj", "sector 12"),
    ("b block sector 43", "sector 43"),
    ("sector-33 sohna road", "sector 33"),
    ("sector 1 manesar", "manesar"),
    ("sector 4 phase 2", "sector 4"),
    ("sector 1a manesar", "manesar"),
    ("c block sector 43", "sector 43"),
    ("sector 89 a", "sector 89"),
    ("sector 2 extension", "sector 2"),
    ("sector 36 sohna road", "sector 36"),
]

# FIXED VALUES: minimum occurrences for a locality to be kept (between rounds).
LOCALITY_MIN_COUNT = 3

# FIXED VALUES: city name removed from the locality text.
CITY_NAME = "Gurgaon"

# FIXED VALUES: luxury weight per facility label.
LUXURY_WEIGHTS = {
    "24/7 Power Backup": 8,
    "24/7 Water Supply": 4,
    "24x7 Security": 7,
    "ATM": 4,
    "Aerobics Centre": 6,
    "Airy Rooms": 8,
    "Amphitheatre": 7,
    "Badminton Court": 7,
    "Banquet Hall": 8,
    "Bar/Chill-Out Lounge": 9,
    "Barbecue": 7,
    "Basketball Court": 7,
    "Billiards": 7,
    "Bowling Alley": 8,
    "Business Lounge": 9,
    "CCTV Camera Security": 8,
    "Cafeteria": 6,
    "Car Parking": 6,
    "Card Room": 6,
    "Centrally Air Conditioned": 9,
    "Changing Area": 6,
    "Children's Play Area": 7,
    "Cigar Lounge": 9,
    "Clinic": 5,
    "Club House": 9,
    "Concierge Service": 9,
    "Conference room": 8,
    "Creche/Day care": 7,
    "Cricket Pitch": 7,
    "Doctor on Call": 6,
    "Earthquake Resistant": 5,
    "Entrance Lobby": 7,
    "False Ceiling Lighting": 6,
    "Feng Shui / Vaastu Compliant": 5,
    "Fire Fighting Systems": 8,
    "Fitness Centre / GYM": 8,
    "Flower Garden": 7,
    "Food Court": 6,
    "Foosball": 5,
    "Football": 7,
    "Fountain": 7,
    "Gated Community": 7,
    "Golf Course": 10,
    "Grocery Shop": 6,
    "Gymnasium": 8,
    "High Ceiling Height": 8,
    "High Speed Elevators": 8,
    "Infinity Pool": 9,
    "Intercom Facility": 7,
    "Internal Street Lights": 6,
    "Internet/wi-fi connectivity": 7,
    "Jacuzzi": 9,
    "Jogging Track": 7,
    "Landscape Garden": 8,
    "Laundry": 6,
    "Lawn Tennis Court": 8,
    "Library": 8,
    "Lounge": 8,
    "Low Density Society": 7,
    "Maintenance Staff": 6,
    "Manicured Garden": 7,
    "Medical Centre": 5,
    "Milk Booth": 4,
    "Mini Theatre": 9,
    "Multipurpose Court": 7,
    "Multipurpose Hall": 7,
    "Natural Light": 8,
    "Natural Pond": 7,
    "Park": 8,
    "Party Lawn": 8,
    "Piped Gas": 7,
    "Pool Table": 7,
    "Power Back up Lift": 8,
    "Private Garden / Terrace": 9,
    "Property Staff": 7,
    "RO System": 7,
    "Rain Water Harvesting": 7,
    "Reading Lounge": 8,
    "Restaurant": 8,
    "Salon": 8,
    "Sauna": 9,
    "Security / Fire Alarm": 9,
    "Security Personnel": 9,
    "Separate entry for servant room": 8,
    "Sewage Treatment Plant": 6,
    "Shopping Centre": 7,
    "Skating Rink": 7,
    "Solar Lighting": 6,
    "Solar Water Heating": 7,
    "Spa": 9,
    "Spacious Interiors": 9,
    "Squash Court": 8,
    "Steam Room": 9,
    "Sun Deck": 8,
    "Swimming Pool": 8,
    "Temple": 5,
    "Theatre": 9,
    "Toddler Pool": 7,
    "Valet Parking": 9,
    "Video Door Security": 9,
    "Visitor Parking": 7,
    "Water Softener Plant": 7,
    "Water Storage": 7,
    "Water purifier": 7,
    "Yoga/Meditation Area": 7,
}

# FIXED VALUES: extra-room labels flagged by substring.
ADDITIONAL_ROOMS = ["study room", "servant room", "store room", "pooja room", "others"]

# FIXED VALUES: age categories, tested in this order by substring.
AGE_RULES = [
    (["0 to 1 Year Old", "Within 6 months", "Within 3 months"], "New Property"),
    (["1 to 5 Year Old"], "Relatively New"),
    (["5 to 10 Year Old"], "Moderately Old"),
    (["10+ Year Old"], "Old Property"),
    (["Under Construction", "By"], "Under Construction"),
]
AGE_UNDEFINED = "Undefined"
AGE_DATED = "Under Construction"

# FIXED VALUES: luxury bins [low, high) except the last, which is closed.
LUXURY_BINS = [(0, 50, "Low"), (50, 150, "Medium"), (150, 175, "High")]
# FIXED VALUES: floor bins, closed on both sides.
FLOOR_BINS = [(0, 2, "Low Floor"), (3, 10, "Mid Floor"), (11, 51, "High Floor")]

# FIXED VALUES: unit constants.
CRORE = 10_000_000
LAC_PER_CRORE = 100
SQFT_PER_SQM = 10.7639
PLOT_SCALE = {9: 9.0, 11: 10.7}

# FIXED VALUES: built-up area ratios (super / built-up, carpet / built-up).
SUPER_TO_BUILT = 1.105
CARPET_TO_BUILT = 0.9

# FIXED VALUES: anomaly repair thresholds (built-up area, price in crore).
ANOMALY_AREA_BELOW = 2000
ANOMALY_PRICE_ABOVE = 2.5

# FIXED VALUES: floor fill value (the house median).
FLOOR_FILL = 2.0

# FIXED VALUES: the configurations of the price-details dictionary.
CONFIGS = ["1 BHK", "2 BHK", "3 BHK", "4 BHK", "5 BHK", "6 BHK", "1 RK", "Land"]

# FIXED VALUES: missing landmark distance in metres.
MISSING_DISTANCE_M = 54000.0

# FIXED VALUES: hybrid weights of the facilities, price and location views.
HYBRID_WEIGHTS = {"facilities": 30.0, "price": 20.0, "location": 8.0}

# FIXED VALUES: prediction band and rounding.
BAND_LOW = 0.87
BAND_HIGH = 1.13

# FIXED VALUES: the model table's feature order.
MODEL_FEATURES = [
    "property_type", "sector", "bedRoom", "bathroom", "balcony",
    "agePossession", "built_up_area", "servant room", "store room",
    "furnishing_type", "luxury_category", "floor_category",
]

# FIXED VALUES: request validation ranges (inclusive).
REQUEST_RANGES = {"bedRoom": (1, 6), "bathroom": (1, 6), "built_up_area": (300, 10000)}

# FIXED VALUES: furnishing codes.
FURNISHING_NAMES = {0: "unfurnished", 1: "semifurnished", 2: "furnished"}

# FIXED VALUES: unit words for distances.
KM_WORDS = ["Km", "KM"]
METER_WORDS = ["Meter", "meter"]


# FIXED: Spark ML's English stop words (StopWordsRemover's default list), in its order.
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they",
    "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those",
    "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does",
    "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at",
    "by", "for", "with", "about", "against", "between", "into", "through", "during", "before", "after", "above",
    "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then",
    "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most",
    "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t",
    "can", "will", "just", "don", "should", "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll",
    "i'd", "you'd", "he'd", "she'd", "we'd", "they'd", "i'm", "you're", "he's", "she's", "it's", "we're",
    "they're", "i've", "we've", "you've", "they've", "isn't", "aren't", "wasn't", "weren't", "haven't",
    "hasn't", "hadn't", "don't", "doesn't", "didn't", "won't", "wouldn't", "shan't", "shouldn't", "mustn't",
    "can't", "couldn't", "cannot", "could", "here's", "how's", "let's", "ought", "that's", "there's", "what's",
    "when's", "where's", "who's", "why's", "would",
]

# FIXED: a value followed by its square metres, as in "1800.0 (167.23 sq.m.)".
SQM_PATTERN = r"(\d+\.?\d*) \((\d+\.?\d*) sq.m.\)"
