"""tracelake.sources"""
