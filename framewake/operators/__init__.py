"""DataFrame operators over clips, tracks, windows, answers, sightings and events."""
