"""Set-oriented operators over whole workspace tables."""
