"""Where clips, detections and answers come from, and where events go."""
