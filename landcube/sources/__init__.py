"""landcube.sources"""
