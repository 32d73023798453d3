"""Label vocabularies and parameter defaults of the data model."""

# The vocabularies below are part of the exchanged data format.
NODE_TYPES = ("TIP_NODE", "BASE_NODE", "BRANCHING_NODE", "ROOT_NODE")
TIP, BASE, BRANCH, ROOT = NODE_TYPES
RESERVED_IDS = {"UNASSIGNED": 1, "IGNORED": 2, "AXON": 3}
UNASSIGNED_ID, IGNORED_ID, AXON_ID = 1, 2, 3
FIRST_OBJECT_ID = 4
LOCATIONS = ("GROWTHCONE", "FILOPODIUM")
CORE_LOCATION, FILAMENT_LOCATION = LOCATIONS
GEOMETRY = ("AUTOMATIC", "MANUAL")
BULBOUS = ("BULBOUS", "NONBULBOUS")
MANDATORY_GROUPS = {
    "Filopodia": ("UNASSIGNED", "IGNORED", "AXON"),
    "TimeStep": (),
    "NodeType": NODE_TYPES,
    "ManualGeometry": GEOMETRY,
    "Location": LOCATIONS,
    "ManualNodeMatch": ("UNASSIGNED", "IGNORED", "AXON"),
    "GrowthCones": (),
}
ROOT_GRAPH_GROUPS = ("TimeStep", "NodeType", "GrowthCones")
OPTIONAL_GROUPS = {"Bulbous": BULBOUS}
LABEL_MIGRATIONS = {
    "STARTING_NODE": "BASE_NODE",
    "ENDING_NODE": "TIP_NODE",
    "INSIDE": "GROWTHCONE",
    "OUTSIDE": "FILOPODIUM",
}

# Parameter defaults.
SPEED_THRESHOLD = 0.1
TRACK_DISTANCE = 1.0
OVERLAP_FRACTION = 0.65
SAMPLING_DISTANCE = 1.0
CORRESPONDENCE_DISTANCE = 3.0
INTENSITY_WEIGHT = 100.0
INTENSITY_POWER = 1.0
TOP_BRIGHTNESS = 255.0
BASE_SIGNIFICANCE = 3000.0
THICKNESS_THRESHOLD = 0.4
TUBE_SLOPE = 2.5
TUBE_ZERO = 4.0
MIN_SEGMENT_SIZE = 50
MIN_MATCH_SIZE = 3
MIN_CLIQUE = 3
REFIT_GAIN = 0.01
VOXEL_SIZE = (0.1, 0.1, 0.5)
MAX_STEPS = 1000  # time labels are T_000 ... T_999
