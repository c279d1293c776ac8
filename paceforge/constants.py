"""Domain constants.  Fixed values: results depend on each of them."""

from __future__ import annotations

import math

#: Karvonen zone limits as shares of the heart-rate reserve, then the cap.
ZONE_SHARES = (0.5, 0.6, 0.7, 0.8, 0.9)
ZONE_CAP = 300
#: Load per minute in the six bands.
ZONE_COEFFICIENTS = (0.5, 1.0, 2.0, 3.0, 4.0, 5.0)
RESTING_HR = 53

STOP_VELOCITY = 0.15
MOVING_VELOCITY = 0.3
ELEVATION_COEFFICIENT = 0.45
WALK_DISCOUNT = 0.5

MIN_STREAM_POINTS = 120
MIN_PAUSE_S = 30
MAX_PAUSE_GAP_S = 3
MIN_ALTITUDE_POINTS = 60
MIN_CLIMB_HOURS = 0.05

FATIGUE_HALF_LIFE, FITNESS_HALF_LIFE = 10, 42
ALPHA_FATIGUE = 1 - math.exp(math.log(0.5) / FATIGUE_HALF_LIFE)
ALPHA_FITNESS = 1 - math.exp(math.log(0.5) / FITNESS_HALF_LIFE)
WARM_UP_DAYS = 90
EASY_DAY_LOAD = 80.0
MAX_HORIZON_DAYS = 90

FORM_TIRED_BELOW, FORM_NORMAL_BELOW = -5.0, 10.0
ACWR_SWEET_LOW, ACWR_SWEET_HIGH, ACWR_DANGER = 0.8, 1.3, 1.35

ROLLING_WINDOWS = (7, 14, 28, 42, 90)

DRIFT_THRESHOLDS = {"Run": 10.0, "TrailRun": 12.0, "VirtualRun": 10.0, "Hike": 8.0, "Walk": 6.0}
DRIFT_DEFAULT_THRESHOLD = 10.0

#: Sport, display name, category, adds to load, running mechanics, heart rate is meaningful, efficiency windows.
SPORTS = (
    ("Run", "Run", "foot", True, True, True, (7, 28, 90)),
    ("TrailRun", "Trail Run", "foot", True, True, True, (7, 28, 90)),
    ("VirtualRun", "Virtual Run", "foot", True, True, True, (7, 28, 90)),
    ("Walk", "Walk", "foot", False, False, True, (7, 28)),
    ("Hike", "Hike", "foot", True, False, True, (28, 90)),
    ("Wheelchair", "Wheelchair", "foot", False, False, True, ()),
    ("Ride", "Ride", "cycle", True, False, True, (7, 28, 90)),
    ("VirtualRide", "Virtual Ride", "cycle", True, False, True, (7, 28, 90)),
    ("MountainBikeRide", "Mountain Bike", "cycle", True, False, True, (7, 28, 90)),
    ("GravelRide", "Gravel Ride", "cycle", True, False, True, (7, 28, 90)),
    ("EBikeRide", "E-Bike Ride", "cycle", False, False, True, ()),
    ("EMountainBikeRide", "E-MTB Ride", "cycle", False, False, True, ()),
    ("Velomobile", "Velomobile", "cycle", False, False, False, ()),
    ("Handcycle", "Handcycle", "cycle", False, False, True, ()),
    ("Swim", "Swim", "water", True, False, True, (7, 28)),
    ("VirtualRow", "Virtual Row", "water", True, False, True, (7, 28)),
    ("Rowing", "Rowing", "water", True, False, True, (7, 28)),
    ("Canoeing", "Canoe", "water", False, False, False, ()),
    ("Kayaking", "Kayak", "water", True, False, True, (28,)),
    ("StandUpPaddling", "Stand Up Paddling", "water", True, False, True, (28,)),
    ("Kitesurf", "Kitesurf", "water", False, False, False, ()),
    ("Surfing", "Surf", "water", False, False, False, ()),
    ("Sail", "Sailing", "water", False, False, False, ()),
    ("Windsurf", "Windsurf", "water", False, False, False, ()),
    ("NordicSki", "Nordic Ski", "winter", True, False, True, (7, 28, 90)),
    ("BackcountrySki", "Backcountry Ski", "winter", True, False, True, (28, 90)),
    ("Snowshoe", "Snowshoe", "winter", True, False, True, (28, 90)),
    ("RollerSki", "Roller Ski", "winter", True, False, True, (7, 28, 90)),
    ("AlpineSki", "Alpine Ski", "winter", False, False, False, ()),
    ("Snowboard", "Snowboard", "winter", False, False, False, ()),
    ("IceSkate", "Ice Skate", "winter", False, False, False, ()),
    ("Workout", "Workout", "gym", True, False, True, (7, 28)),
    ("Crossfit", "Crossfit", "gym", True, False, True, (7, 28)),
    ("WeightTraining", "Weight Training", "gym", True, False, True, (7, 28, 90)),
    ("Elliptical", "Elliptical", "gym", True, False, True, (7, 28)),
    ("StairStepper", "Stair Stepper", "gym", True, False, True, (7, 28)),
    ("HighIntensityIntervalTraining", "HIIT", "gym", True, False, True, (7, 28)),
    ("Yoga", "Yoga", "gym", False, False, True, ()),
    ("Pilates", "Pilates", "gym", False, False, False, ()),
    ("Soccer", "Football (Soccer)", "other", True, False, True, (7, 28)),
    ("Tennis", "Tennis", "other", True, False, True, (7, 28)),
    ("Badminton", "Badminton", "other", False, False, False, ()),
    ("Golf", "Golf", "other", False, False, False, ()),
    ("InlineSkate", "Inline Skate", "other", False, False, False, ()),
    ("Pickleball", "Pickleball", "other", False, False, False, ()),
    ("Racquetball", "Racquetball", "other", False, False, False, ()),
    ("RockClimbing", "Rock Climb", "other", False, False, False, ()),
    ("Skateboard", "Skateboarding", "other", False, False, False, ()),
    ("Squash", "Squash", "other", False, False, False, ()),
    ("TableTennis", "Table Tennis", "other", False, False, False, ()),
)
RUNNING_SPORTS = tuple(s[0] for s in SPORTS if s[4])

#: Stream channels that a refresh asks for.
REQUESTED_CHANNELS = (
    "time", "distance", "latlng", "altitude", "velocity_smooth", "heartrate", "cadence", "watts", "temp", "moving",
    "grade_smooth", "grade_adjusted_speed", "grade_adjusted_distance",
)
