"""Fixed values of the data model: bands, classes, thresholds, windows."""

# Band order, index order and feature sets.
BANDS = ["B2", "B3", "B4", "B8", "B11", "B12"]
INDICES = ["NDVI", "NDBI", "NDWI"]
FEATURES_9 = BANDS + INDICES
FEATURES_5 = ["B4", "B8", "B11", "NDVI", "NDBI"]
EDGE_FEATURES = ["edge_density", "sobel_gradient"]
TEXTURE_FEATURES = [
    "glcm_contrast", "glcm_entropy", "glcm_homogeneity", "glcm_dissimilarity",
]

# Raw digital numbers and their valid range.
REFLECTANCE_SCALE = 10000
VALID_RAW_MIN = 0
VALID_RAW_MAX = 10000

# Scene classification codes treated as cloud, shadow or cirrus.
SCL_CLOUD_CODES = [3, 8, 9, 10]
QA_CLOUD_BITS = [3, 4]
LANDSAT_GAIN = 0.0000275
LANDSAT_OFFSET = -0.2

# Project classes.
CLASS_NAMES = {0: "Water", 1: "Vegetation", 2: "Bare Soil", 3: "Built-up"}
BUILT_UP = 3
# The older draft of the analysis numbers the classes the other way round.
CLASS_NAMES_DRAFT = {0: "Built-up", 1: "Vegetation", 2: "Bare Soil", 3: "Water"}

# Global land-cover code -> project class, by remapping scheme.
LANDCOVER_SCHEMES = {
    # unlisted codes become the default (-1)
    "server": ({10: 1, 20: 1, 30: 1, 40: 1, 50: 3, 60: 2, 80: 0, 90: 0, 95: 0}, -1),
    # unlisted codes become the class raster's no-data value (255)
    "local": ({10: 1, 20: 1, 30: 1, 40: 1, 50: 3, 60: 2, 80: 0, 90: 0, 95: 0}, 255),
    # every code is listed; anything else is masked
    "full": (
        {10: 1, 20: 1, 30: 1, 40: 1, 50: 3, 60: 2, 70: 2, 80: 0, 90: 0, 95: 0, 100: 1},
        None,
    ),
}

# Sampling.
STUDY_YEARS = [2018, 2020, 2022, 2024, 2026]
SAMPLES_PER_YEAR = 20000
SAMPLES_PER_CLASS = 300
MIN_SAMPLES_PER_CLASS = 120
WATER_OVERSAMPLE = 950
WATER_NDWI_MIN = 0.0
SEED = 42
TRAIN_FRACTION = 0.7
HAND_POINTS = 80
N_TREES = 200
MAX_SCENE_CLOUD = 60

# Geography of the study area.
UTM_ZONE = 48
AIRPORT_CENTER = (107.04111, 10.78444)
RINGS_M = [0, 2000, 4000, 6000]
ROAD_BANDS_M = [0, 100, 250, 500, 1000]
COMPASS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]
ROAD_CLASSES = ["motorway", "trunk", "primary", "secondary"]
PIXEL_AREA_HA = 0.01

# Edge and line detection.
CANNY_PERCENTILE = 0.9
CANNY_LOW_RATIO = 0.4
CANNY_MIN_COMPONENT = 8
EROSION_STEPS = 5
MIN_SEGMENT_M = 1500
LINE_GAP_PX = 20
ANGLE_TOLERANCE_DEG = 7.0
HOUGH_PEAKS = 5
