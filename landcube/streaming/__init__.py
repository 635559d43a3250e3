"""landcube.streaming"""
