"""Fixed values of the audit: thresholds, word lists and defaults. Results depend on them exactly."""

# Fixed values.
OPEN_THRESHOLD = 0.5  # gripper readings: 0 closed, 1 open
HOLD_ABOVE = 0.01
AIR_UP_TO = 0.006
SETTLED_BELOW = 0.01
SETTLED_LAG = 3
MIN_HOLD_S = 0.3
RELEASE_WINDOW_S = 0.5
HANDOVER_BELOW_M = 0.30
BOX_PAD = 0.25
FRAME_WIDTH = 640.0
SETTLED_MOVE = 0.08
FULL_MOVE = 0.16
PRESENT_SHARE = 0.5
REST_SPEED = 60.0
MIN_REST_S = 1.0
SCORE_WINDOW_S = 3.0
TAG_THRESHOLD = 0.5
DEFAULT_FPS = 30.0
SAUCER_WORDS = ("saucer", "plate", "tray", "dish")
CUP_WORDS = ("cup", "mug")
CLIP_SUFFIXES = ("mp4", "mov", "avi")
SUCCESS, FAILURE, SPLIT = "success", "failure", "split"
