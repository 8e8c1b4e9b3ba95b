"""Native column expressions over bytes."""
